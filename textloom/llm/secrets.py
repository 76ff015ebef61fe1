"""Secret scans: known forms, and strings that a primed compressor finds new.

Beside the base forms, each run of key characters that stands close to a sensitive word, on either side, or close to a secret so
found (as in a list) is a candidate. Its novelty is its marginal compressed size: bytes that a zstandard compressor, primed with a
dictionary of common identifiers, needs for the text around it with the candidate less those without, over the candidate's length. What
can't be compressed there, and holds letters and digits or letters whose case changes as in no identifier, is reported. Letters of one
case alone are not: words that the dictionary lacks are as new. A PEM block of a private key is one span, from BEGIN to END.

Defined results: a null or empty text has no spans; a candidate that a base span overlaps is that base span only (a PEM block is
reported all the same); a block without its end is as long as its lines of key characters;
spans are in code points, end exclusive; texts are searched whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import emitted, prepare, rows, table, texts

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What makes a context sensitive, how near it must be, and what a candidate is made of.
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|signing.?key|credential|bearer|authorization|client.?id|AKIA|BEGIN [A-Z ]*PRIVATE KEY", re.I | re.A)
REACH, AROUND, LEAST = 64, 192, 12
#: A private key whole; where its end is missing, its lines.
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|(?:[\s\\\"'+,]+[A-Za-z0-9+/=]{16,})++)")
#: What letters of random case have and identifiers rarely: a lone small letter between capitals, several capitals.
RESTLESS = re.compile(r"[A-Z][a-z](?=[A-Z])|[A-Z]{2,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{%d,}" % LEAST)
#: Marginal compressed bytes per character from which a string counts as new.
NOVEL = 0.7
#: From this on what compresses may do so as alike characters stand around it, not copies: it is tried without the runs around.
ALIKE = 0.55
#: The host of an address, which stands behind its @.
HOST = re.compile(r"(?:[a-z0-9-]+\.)+[a-z]{2,}")

#: Common identifiers and words of code and configuration; the dictionary that primes the compressor.
IDENTIFIERS = """
import from return class function const static public private protected void string number boolean default export extends
interface implements package include define struct typedef namespace using template virtual override final abstract async await yield
lambda print println printf format length size count index value values key keys name names path paths file filename directory config
configuration settings options parameters arguments argument environment variable username user password passwd passphrase secret
secrets token tokens access_token refresh_token auth_token bearer authorization authentication credential credentials api_key apikey
api_secret client_id client_secret private_key public_key access_key secret_key signing_key session session_id cookie header headers
content-type application/json text/html charset=utf-8 request response server client connect connection database host hostname port
localhost 127.0.0.1 0.0.0.0 http:// https:// www. .com .org .net index.html timeout retry buffer encode decode base64 sha256 md5 hash
digest signature certificate BEGIN END RSA PRIVATE KEY PUBLIC CERTIFICATE -----BEGIN -----END example changeme placeholder
your_password_here your-api-key xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
the and for with that this have from they will would there their what about which when make like time just know take people into year
""".encode()


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    novelty: float


@cache
def _compressor() -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(text: str, start: int, end: int, runs: bool = True) -> float:
    """Marginal compressed bytes per character of text[start:end] against what stands around it, with or without runs of key characters."""
    around = text[end : end + AROUND] + "\n" + text[max(0, start - AROUND) : start]
    around = (around if runs else CANDIDATE.sub(" ", around)).encode("utf-8", "surrogatepass")
    size = _compressor().compress
    return max(0, len(size(around + text[start:end].encode())) - len(size(around))) / (end - start)


def base_spans(text: str) -> list[Span]:
    """The base forms, leftmost and without overlap for each kind."""
    found = [Span("assign", m.start(), m.end(), 1.0) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        found += [Span("access", m.start(), m.end(), 1.0) for m in ACCESS.finditer(text)]
    return found + [Span("hex", m.start(), m.end(), 1.0) for m in HEX.finditer(text)]


def _random(own: str) -> bool:
    """Whether a candidate has letters and digits, or letters whose case changes as in no identifier."""
    if not any(x.isalpha() for x in own):
        return False
    return any(x.isdigit() for x in own) or len(RESTLESS.findall(own)) >= max(2, len(own) / 8)


def novel_spans(text: str, known: list[Span]) -> list[Span]:
    """PEM blocks, and candidates near a sensitive word or another secret near one that overlap nothing known and don't compress."""
    words = [(m.start(), m.end()) for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    found = {m.start(): Span("novel", m.start(), m.end(), novelty(text, m.start(), m.end())) for m in PEM.finditer(text)}
    taken: list[list[int]] = []
    for start, end in sorted((s.start, s.end) for s in [*known, *found.values()]):
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    starts = [t[0] for t in taken]
    runs = [(m.start(), m.end()) for m in CANDIDATE.finditer(text)]

    @cache
    def secret(start: int, end: int) -> bool:
        i = bisect_left(starts, end) - 1
        if i >= 0 and taken[i][1] > start:
            return True
        own = text[start:end]
        if not _random(own) or (text[start - 1 : start] == "@" and HOST.fullmatch(own)):
            return False
        new = novelty(text, start, end)
        if ALIKE <= new < NOVEL:
            new = novelty(text, start, end, runs=False)
        if new >= NOVEL:
            found[start] = Span("novel", start, end, new)
            return True
        return False

    # forwards: what begins within reach of a word or of the last secret; backwards: what ends within reach
    i, reach = 0, -1
    for start, end in runs:
        while i < len(words) and words[i][0] < end:
            reach, i = max(reach, words[i][1] + REACH), i + 1
        if start < reach and secret(start, end):
            reach = max(reach, end + REACH)
    i, reach = len(words) - 1, len(text) + 1
    for start, end in reversed(runs):
        while i >= 0 and words[i][1] > start:
            reach, i = min(reach, words[i][0] - REACH), i - 1
        if end > reach and secret(start, end):
            reach = min(reach, start - REACH)
    return list(found.values())


def spans(text: str | None) -> list[Span]:
    """All spans of a text, by start, then kind."""
    if not text:
        return []
    known = base_spans(text)
    return sorted(known + novel_spans(text, known), key=lambda s: (s.start, KINDS.index(s.kind)))


def redacted(text: str | None, mark: str = "[redacted]") -> str | None:
    """A text with every span replaced; overlapping spans are replaced as one."""
    found = spans(text)
    if not found:
        return text
    out, at, end = [], 0, -1
    for s in found:
        if s.start >= end:
            out += [text[at : s.start] if end < 0 else text[end : s.start], mark]
            end = s.end
        else:
            end = max(end, s.end)
    return "".join([*out, text[end:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of kind, start, end, novelty."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", kind)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emitted(schema, ((i, [s._asdict() for s in spans(t)]) for b in batches for i, t in rows(b, doc_id=pa.int64(), text=pa.string())))

    return texts(docs).mapInArrow(each, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,novelty:double>>")


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with secrets replaced in text, and n_chars (where there is one) counted again."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def hidden(text):  # noqa: ANN001, ANN202
        return text.map(redacted, na_action="ignore")

    out = docs.withColumn("text", hidden(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), count("novel"))
