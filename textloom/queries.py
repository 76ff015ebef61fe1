"""The engine's operators as named queries over the given tables, and the same in SQL.

Every query runs over whole tables. Small fixed inputs (fixtures) stand where the tables have nothing that an operator works on,
such as code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import engine as eng
from textloom.engine import Engine, Options
from textloom.functions import highlight
from textloom.functions.lexical import byte_classes, code_stats
from textloom.functions.matching import levenshtein_bytes, locate
from textloom.operators import lines, postings, ranking, results, snippets
from textloom.query.nodes import Keyword, Regex
from textloom.query.rewrite import positive
from textloom.session import spread
from textloom.sources import corpus
from textloom.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Documents as the engine sees them, in SQL.
DOCS = """(SELECT coalesce(source,'') || '/' || coalesce(lang,'') || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS filename, coalesce(lang,'') AS language,
 'txt' AS extension, coalesce(text,'') AS content, CAST(strlen(coalesce(text,'')) - strlen(replace(coalesce(text,''), chr(10), '')) AS BIGINT) AS complexity,
 CAST(strlen(coalesce(text,'')) AS BIGINT) AS bytes FROM documents) docs"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def matching(name: str, text: str, where: str, **options: object) -> None:
    """A query whose result is the paths of the documents that match."""
    o = Options(**options)
    add(name, lambda s, d: Engine().match(docs(s, d), text, o).hits.select("path"), f"SELECT path FROM {DOCS} WHERE {where}")


def has(term: str) -> str:
    return f"contains(lower(content), '{term}')"


# --- predicates
matching("kw_and", "thintion menttre", f"{has('thintion')} AND {has('menttre')}")
matching("kw_and_both", "enein enung", f"{has('enein')} AND {has('enung')}")
matching("kw_or", "thintion OR menttre", f"{has('thintion')} OR {has('menttre')}")
matching("kw_not", "license NOT thintion", f"{has('license')} AND NOT {has('thintion')}")
matching("kw_default_or", "thintion einlich", f"{has('thintion')} OR {has('einlich')}", default_operator="or")
matching("kw_case_sensitive", "The", "contains(content, 'The')", sensitive=True)
matching("kw_precedence", "einlich OR thintion AND onbleea", f"{has('einlich')} OR ({has('thintion')} AND {has('onbleea')})")
matching("kw_group", "(einlich OR thintion) AND NOT (onbleea OR thshing)", f"({has('einlich')} OR {has('thintion')}) AND NOT ({has('onbleea')} OR {has('thshing')})")
matching("phrase", '"of the"', has("of the"))
matching("phrase_punctuation", '"MIT License"', has("mit license"))
matching("regex_match", r"/[A-Z][a-z]+ion\b/", r"regexp_matches(content, '[A-Z][a-z]+ion\b')")
matching("regex_anchored", r"/^The [a-z]+/", "regexp_matches(content, '^The [a-z]+')")
matching("regex_end", r"/th\.$/", r"regexp_matches(content, 'th\.$')")
matching("regex_class", "/[[:upper:]]{5}[[:digit:]]/", "regexp_matches(content, '[[:upper:]]{5}[[:digit:]]')")
matching("regex_class_word", "/[[:upper:]][[:lower:]]{9}[[:space:]]/", "regexp_matches(content, '[[:upper:]][[:lower:]]{9}[[:space:]]')")
matching("regex_invalid", "/(?=the)/", "false")
matching("filter_lang", "lang=de", "language = 'de'")
matching("filter_lang_multi", "lang=de,FR", "language IN ('de', 'fr')")
matching("filter_lang_not", "lang!=en", "language <> 'en'")
matching("filter_ext", "thintion ext:txt", has("thintion"))
matching("filter_file_sub", "file:99", "contains(filename, '99')")
matching("filter_file_glob", "file:1?5.txt", "regexp_full_match(filename, '1[^/]5\\.txt')")
matching("filter_file_class", "file:[12]*[0-4].txt", "regexp_full_match(filename, '[12][^/]*[0-4]\\.txt')")
matching("filter_file_not_glob", "file!=*0.txt", "NOT regexp_full_match(filename, '[^/]*0\\.txt')")
matching("filter_path_sub", "path:src1/de", "contains(path, 'src1/de')")
matching("filter_path_glob", "path:src1*/es/*", "regexp_matches(path, '(^|/)src1[^/]*/es/[^/]*($|/)')")
matching("filter_path_not", "path!=src1", "NOT contains(path, 'src1')")
matching("filter_complexity", "complexity>=20", "complexity >= 20")
matching("filter_complexity_list", "complexity=3,5,7", "complexity IN (3, 5, 7)")
matching("filter_complexity_colon", "complexity:<=3 thintion", f"complexity <= 3 AND {has('thintion')}")
matching("complexity_alias", "complexity=high", "complexity >= 8")
matching("hoist_or_filter", "thintion einlich lang:en", f"({has('thintion')} OR {has('einlich')}) AND language = 'en'", default_operator="or")
matching("two_phase_or", "thintion OR lang:de", "true", two_phase=True)
matching("two_phase_not", "NOT (thintion lang:en)", f"NOT {has('thintion')} AND language <> 'en'", two_phase=True)
matching("healed_query", "(thintion OR menttre", f"{has('thintion')} OR {has('menttre')}")
add("lax_invalid", lambda s, d: Engine().match(docs(s, d), "AND", Options(strict=False)).hits.select("path"), f"SELECT path FROM {DOCS} WHERE false")


def _registered(s: SparkSession, d: str) -> DataFrame:
    e = Engine()
    e.register_filter("lang", lambda op, v: F.startswith("language", F.lit(v)))
    e.register_alias("complexity", "low", "<=", 2)
    return e.match(docs(s, d), "lang:e complexity=low").hits.select("path")


add("registered_filter", _registered, f"SELECT path FROM {DOCS} WHERE language LIKE 'e%' AND complexity <= 2")
# one substitution; at either end it may take a byte of a longer character, inside it can't
_NEAR = ["(?s:.)hintiom", *(f"{'thintiom'[:i]}[\\x00-\\x7F]{'thintiom'[i + 1 :]}" for i in range(1, 7)), "thintio(?s:.)"]
add("fuzzy1", lambda s, d: Engine().match(docs(s, d), "thintiom~1").hits.select("path"), f"SELECT path FROM {DOCS} WHERE regexp_matches(lower(content), '{'|'.join(_NEAR)}')")
# windows of seven bytes by edit distance; a character of several bytes stands as so many that the term doesn't have
_BYTES = r"regexp_replace(regexp_replace(regexp_replace(lower(content), '[\x{80}-\x{7FF}]', '##', 'g'), '[\x{800}-\x{FFFF}]', '###', 'g'), '[\x{10000}-\x{10FFFF}]', '####', 'g')"
add("fuzzy2", lambda s, d: Engine().match(docs(s, d), "mentxrx~2").hits.select("path"),
    f"SELECT DISTINCT path FROM (SELECT path, c, unnest(range(1, strlen(c) - 5)) AS i FROM (SELECT path, {_BYTES} AS c FROM {DOCS})) WHERE levenshtein(substr(c, i, 7), 'mentxrx') <= 2")

# --- sources
add("scan_text_filters", lambda s, d: corpus.scanned(docs(s, d)).select("path", "bytes"), f"SELECT path, least(bytes, 1000000) AS bytes FROM {DOCS} WHERE bytes > 0 AND NOT contains(content, chr(0)) AND bytes // (complexity + 1) <= 255")
add("source_pages", lambda s, d: corpus.pages(s.read.parquet(f"{d}/pages.parquet")).select("path", "filename", "language", "extension", F.octet_length("content").cast("long").alias("bytes"), "complexity"),
    "SELECT path, list_last(string_split(path, '/')) AS filename, 'HTML' AS language, 'html' AS extension, CAST(strlen(html) AS BIGINT) AS bytes, CAST(strlen(html) - strlen(replace(html, chr(10), '')) AS BIGINT) AS complexity FROM (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, html FROM pages)")
add("source_conversations", lambda s, d: corpus.conversations(s.read.parquet(f"{d}/conversations.parquet")).select("path", "filename", "language", "complexity"),
    "SELECT conv_id || '/' || coalesce(role,'') || '/' || turn || '.txt' AS path, turn || '.txt' AS filename, coalesce(role,'') AS language, CAST(strlen(coalesce(text,'')) - strlen(replace(coalesce(text,''), chr(10), '')) AS BIGINT) AS complexity FROM conversations")
add("source_events", lambda s, d: corpus.events(s.read.parquet(f"{d}/events.parquet")),
    "SELECT coalesce(event_type,'') || '/' || user_id || '/' || event_id || '.json' AS path, event_id || '.json' AS filename, coalesce(event_type,'') AS language, 'json' AS extension, coalesce(props,'') AS content, CAST(floor(value) AS BIGINT) AS complexity FROM events")
add("source_parts", lambda s, d: Engine().match(corpus.parts(s.read.parquet(f"{d}/part.parquet")), "complexity>=10 complexity<=20").hits.select("path", "complexity"),
    "SELECT p_brand || '/' || p_type || '/' || p_partkey AS path, CAST(p_size AS BIGINT) AS complexity FROM part WHERE p_size BETWEEN 10 AND 20")


def _first_path(s: SparkSession, d: str) -> DataFrame:
    # path names one document: the first
    one = docs(s, d).agg(F.min_by("path", F.expr("int(split_part(filename, '.', 1))"))).first()[0]
    return corpus.file_lines(docs(s, d), one, 2, 5)


add("get_file_lines", _first_path, "SELECT CAST(line AS INTEGER) AS line, content FROM (SELECT unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)) WHERE line BETWEEN 2 AND 5")

# --- postings and statistics
TERMS = ("thintion", "menttre", "einlich", "the")
OR_TERMS = " OR ".join(TERMS)
COUNT = {t: f"CAST((strlen(lower(content)) - strlen(replace(lower(content), '{t}', ''))) // {len(t)} AS BIGINT)" for t in TERMS}
POSTINGS = "(" + " UNION ALL ".join(f"SELECT path, '{t}' AS term, {COUNT[t]} AS tf FROM {DOCS} WHERE {has(t)}" for t in TERMS) + ") postings"
HITS = "(SELECT * FROM " + DOCS + " WHERE " + " OR ".join(map(has, TERMS)) + ") hits"


def _postings(s: SparkSession, d: str) -> DataFrame:
    found = Engine().match(docs(s, d), OR_TERMS)
    return postings.term_frequencies(found.hits, list(positive(found.tree)))


def _hits(s: SparkSession, d: str) -> DataFrame:
    return Engine().match(docs(s, d), OR_TERMS).hits.withColumn("bytes", F.octet_length("content").cast("long"))


add("term_frequency", _postings, f"SELECT path, term, tf FROM {POSTINGS}")
add("document_frequency", lambda s, d: postings.document_frequency(_postings(s, d)), f"SELECT term, count(*) AS df FROM {POSTINGS} GROUP BY term")
add("corpus_frequency", lambda s, d: postings.corpus_frequency(_postings(s, d)), f"SELECT term, CAST(sum(tf) AS BIGINT) AS ctf FROM {POSTINGS} GROUP BY term")
add("average_words", lambda s, d: postings.average_words(_hits(s, d)).select(F.round("avg_words", 6).alias("avg_words")), f"SELECT round(avg(greatest(1, bytes // 2)), 6) AS avg_words FROM {HITS}")
add("regex_count", lambda s, d: postings.term_frequencies(docs(s, d), [Regex("[A-Z][a-z]+ion")]), f"SELECT path, '[A-Z][a-z]+ion' AS term, CAST(len(regexp_extract_all(content, '[A-Z][a-z]+ion')) AS BIGINT) AS tf FROM {DOCS} WHERE regexp_matches(content, '[A-Z][a-z]+ion')")
add("spans", lambda s, d: postings.spans(postings.located(Engine().match(docs(s, d), "license").hits, [Keyword("license")])).select("path", "pos", "s", "e"),
    f"""SELECT path, CAST(i - 1 AS INTEGER) AS pos, CAST(s AS INTEGER) AS s, CAST(s + 7 AS INTEGER) AS e FROM (
    SELECT path, i, list_sum(list_transform(parts[1:i], lambda x: strlen(x))) + 7 * (i - 1) AS s FROM (
    SELECT path, parts, unnest(range(1, len(parts))) AS i FROM (SELECT path, string_split(lower(content), 'license') AS parts FROM {DOCS})))""")

# --- rankers
RANKED = ("thintion", "menttre", "onbleea")
RANK_QUERY = " OR ".join(RANKED)
RANK_TERMS = (*RANKED, RANK_QUERY)


def scored_sql(one: str, ranked: tuple[str, ...] = RANKED) -> str:
    """path, language, complexity, bytes, score, found terms: one(tf, df) added over terms, of documents that hold any."""
    tf = {t: f"(strlen(lower(content)) - strlen(replace(lower(content), '{t}', ''))) / {len(t)}.0" for t in ranked}
    cols = ", ".join(f"{e} AS tf{i}" for i, e in enumerate(tf.values()))
    dfs = ", ".join(f"greatest(1, count(*) FILTER (tf{i} > 0) OVER ()) AS df{i}" for i in range(len(ranked)))
    total = " + ".join(f"CASE WHEN tf{i} > 0 THEN {one.format(tf=f'tf{i}', df=f'df{i}')} ELSE 0 END" for i in range(len(ranked)))
    return f"""(SELECT *, {total} AS score FROM (SELECT *, avg(words) OVER () AS avg_words, {dfs} FROM (
      SELECT path, language, complexity, bytes, greatest(1, bytes // 2) AS words, (SELECT count(*) FROM documents) AS scanned, {cols} FROM {DOCS}) WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(ranked)))})) scored"""


def bm25_sql(k1: float = 1.2, b: float = 0.75) -> str:
    return f"log10(1 + scanned / {{df}}) * {{tf}} * {k1 + 1} / ({{tf}} + {k1} * ({1 - b} + {b} * words / avg_words))"


def ranker(name: str, which: str, one: str, profile: ranking.Profile = ranking.Profile()) -> None:
    """A base ranker without modifiers."""
    off = ranking.Profile(profile.k1, profile.b, 0.0, 100.0, 1.0, 0.0)
    o = Options(ranker=which, profile=off, phrase_boost=False)
    add(name, lambda s, d: _scores(s, d, o), f"SELECT path, round(score, 6) AS score FROM {scored_sql(one)}")


def _scores(s: SparkSession, d: str, o: Options, query: str = RANK_QUERY) -> DataFrame:
    e = Engine()
    corpus_ = docs(s, d)
    return e.rank(corpus_, e.match(corpus_, query, o), o).select("path", F.round("score", 6).alias("score"))


ranker("rank_simple", "simple", "0.0::DOUBLE")
ranker("rank_tfidf", "tfidf", "sqrt({tf} / words) * log10(scanned / {df}) / sqrt(words)")
ranker("rank_tfidf_classic", "tfidf_classic", "({tf} / words) * log10(scanned / {df})")
ranker("rank_bm25", "bm25", bm25_sql())
ranker("rank_bm25_precise", "bm25", bm25_sql(0.3, 0.95), ranking.PROFILES["precise"])
ranker("rank_bm25_broad", "bm25", bm25_sql(2.5, 0.15), ranking.PROFILES["broad"])
add("rank_structural", lambda s, d: _scores(s, d, Options(ranker="structural", profile=ranking.Profile(1.2, 0.75, 0.0, 100.0, 1.0, 0.0), phrase_boost=False)), f"SELECT path, round(score, 6) AS score FROM {scored_sql(bm25_sql())}")
# places of each term, the least gap of each pair of them, and the weakest pair blended with the mean
_places = " UNION ALL ".join(
    f"SELECT path, {k} AS k, s, s + {len(t)} AS e FROM (SELECT path, list_sum(list_transform(parts[1:i], lambda x: strlen(x))) + {len(t)} * (i - 1) AS s FROM (SELECT path, parts, unnest(range(1, len(parts))) AS i FROM (SELECT path, string_split(lower(content), '{t}') AS parts FROM {DOCS})))"
    for k, t in enumerate(RANKED)
)
_ones = "CASE {0} " + " ".join(f"WHEN {k} THEN {bm25_sql().format(tf=f'tf{k}', df=f'df{k}')}" for k in range(len(RANKED))) + " END"
MINIMUM = f"""WITH places AS ({_places}), gaps AS (
  SELECT x.path, x.k AS a, y.k AS b, min(greatest(0, CASE WHEN x.s <= y.s THEN y.s - x.e ELSE x.s - y.e END)) AS gap FROM places x JOIN places y ON x.path = y.path AND x.k < y.k GROUP BY ALL),
  scored AS (SELECT * FROM {scored_sql(bm25_sql())}),
  weakest AS (SELECT path, min(least({_ones.format('a')}, {_ones.format('b')}) * (1 + 1.5 / (gap / 6.0 + 1))) AS least_pair FROM gaps JOIN scored USING (path) GROUP BY path)
  SELECT path, round(CASE WHEN least_pair IS NULL THEN score ELSE 0.9 * least_pair + 0.1 * score / ({' + '.join(f'(tf{k} > 0)::INTEGER' for k in range(len(RANKED)))}) END, 6) AS score FROM scored LEFT JOIN weakest USING (path)"""
add("rank_minimum", lambda s, d: _scores(s, d, Options(ranker="minimum", profile=ranking.Profile(1.2, 0.75, 0.0, 100.0, 1.0, 0.0), phrase_boost=False)),
    MINIMUM)

FULL = f"""SELECT path, round(score * (1 + ln(1 + complexity)) * least(1, (complexity + 1) / log10(greatest(10, bytes))), 6) AS score FROM {scored_sql(bm25_sql())}"""
add("rank_full_chain", lambda s, d: _scores(s, d, Options(ranker="bm25", phrase_boost=False)), FULL)
add("rank_precise_chain", lambda s, d: _scores(s, d, Options(ranker="bm25", phrase_boost=False, profile=ranking.PROFILES["precise"])),
    f"SELECT path, round(score * (1 + ln(1 + complexity) * 2.5) * least(1, (complexity + 1) / log10(greatest(10, bytes)) * 2.5) / (1 + 0.3 * log10(greatest(10, bytes))), 6) AS score FROM {scored_sql(bm25_sql(0.3, 0.95))}")

# --- modifiers, on the paths of the documents
FLAT = ranking.Profile(1.2, 0.75, 0.0, 100.0, 1.0, 0.0)


def modifier(name: str, column: Callable[[], object], sql: str) -> None:
    add(name, lambda s, d: docs(s, d).withColumn("bytes", F.octet_length("content").cast("long")).select("path", F.round(column(), 6).alias("score")), f"SELECT path, round({sql}, 6) AS score FROM {DOCS}")


_five = lambda: F.lit(5.0)
modifier("gravity", lambda: ranking.gravity(_five(), F.col("complexity"), 2.5), "5.0 * (1 + ln(1 + complexity) * 2.5)")
modifier("noise", lambda: ranking.noise(_five(), F.col("complexity"), F.col("bytes"), 0.5), "5.0 * least(1, (complexity + 1) / log10(greatest(10, bytes)) * 0.5)")
modifier("length_bias", lambda: ranking.length_bias(_five(), F.col("bytes"), 0.3), "5.0 / (1 + 0.3 * log10(greatest(10, bytes)))")
modifier("test_dampening", lambda: ranking.test_dampening(_five(), F.concat(F.lit("a/test_"), F.col("filename")), 0.4, False), "2.0::DOUBLE")
modifier("location_boost", lambda: ranking.location(_five(), F.col("path"), F.array(F.lit("src1"), F.lit("de"))),
         "5.0 * (CASE WHEN contains(path, 'src1') THEN 1 + 0.15 * 4 ELSE 1 END) * (CASE WHEN contains(path, 'de') THEN (1 + 0.15 * 2) / (1 + 0.02 * (instr(path, 'de') - 1)) ELSE 1 END) * (CASE WHEN contains(path, 'src1') AND contains(path, 'de') THEN 1.3 ELSE 1 END)")
modifier("filename_boost", lambda: ranking.filename_boost(_five(), F.col("path"), F.array(F.lit("de"), F.lit("9"))),
         "5.0 * (1 + ((CASE WHEN language = 'de' THEN 0.6 ELSE 0 END) + (CASE WHEN filename = '9.txt' THEN 1.0 WHEN contains(filename, '9') THEN 0.6 ELSE 0 END)) * ((CASE WHEN language = 'de' THEN 1 ELSE 0 END) + (CASE WHEN contains(filename, '9') THEN 1 ELSE 0 END)) / 2.0)")

# --- order, pages, facets, duplicates, sets
BM25 = f"(SELECT path, round(score, 6) AS score FROM {scored_sql(bm25_sql())})"
_plain = Options(ranker="bm25", profile=FLAT, phrase_boost=False)
add("topk", lambda s, d: results.top(_scores(s, d, _plain), 20), f"SELECT * FROM {BM25} ORDER BY score DESC, path LIMIT 20")
add("page_offset", lambda s, d: results.top(_scores(s, d, _plain), 10, 5), f"SELECT * FROM {BM25} ORDER BY score DESC, path LIMIT 10 OFFSET 5")
add("page_band", lambda s, d: results.page(_scores(s, d, _plain), 1, 20), f"SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, path) AS INTEGER) AS rank FROM {BM25}) WHERE rank > 20 AND rank <= 40")
add("reverse_topk", lambda s, d: results.reverse(results.top(_scores(s, d, _plain), 5)), f"SELECT * FROM {BM25} ORDER BY score DESC, path LIMIT 5")
add("facet_language", lambda s, d: results.facets(_hits(s, d), "language"), f"SELECT language, count(*) AS n FROM {HITS} GROUP BY language")
add("facet_extension", lambda s, d: results.facets(_hits(s, d)), f"SELECT extension, count(*) AS n FROM {HITS} GROUP BY extension")


def _hashed(s: SparkSession, d: str) -> DataFrame:
    hits = postings.located(Engine().match(docs(s, d), r"/[Ll]icensed[^.\n]*/").hits, [Regex(r"[Ll]icensed[^.\n]*")])
    return hits.select("path", F.lit(0.0).alias("score"), results.match_hash(F.col("content"), F.col("match_locations")).alias("match_hash"))


HASHED = rf"(SELECT path, 0.0 AS score, sha256(array_to_string(regexp_extract_all(content, '[Ll]icensed[^.\n]*'), '')) AS match_hash FROM {DOCS} WHERE regexp_matches(content, '[Ll]icensed[^.\n]*'))"
add("match_hash", lambda s, d: _hashed(s, d).select("path", "match_hash"), f"SELECT path, match_hash FROM {HASHED}")
add("dedup_hash", lambda s, d: results.deduplicated(_hashed(s, d)).select("path", "match_hash", "duplicate_count"), f"SELECT min(path) AS path, match_hash, count(*) - 1 AS duplicate_count FROM {HASHED} GROUP BY match_hash")
add("duplicate_locations", lambda s, d: results.duplicate_locations(_hashed(s, d)), f"SELECT match_hash, path, duplicate_of FROM (SELECT *, min(path) OVER (PARTITION BY match_hash) AS duplicate_of FROM {HASHED}) WHERE path <> duplicate_of")
_paths = lambda s, d, q: Engine().match(docs(s, d), q).hits.select("path")
add("union_paths", lambda s, d: results.union(_paths(s, d, "thintion"), _paths(s, d, "menttre")), f"SELECT path FROM {DOCS} WHERE {has('thintion')} UNION SELECT path FROM {DOCS} WHERE {has('menttre')}")
add("difference_paths", lambda s, d: results.difference(_paths(s, d, "lang=en"), _paths(s, d, "thintion")), f"SELECT path FROM {DOCS} WHERE language = 'en' EXCEPT SELECT path FROM {DOCS} WHERE {has('thintion')}")
add("intersect_paths", lambda s, d: results.intersection(_paths(s, d, "thintion"), _paths(s, d, "onbleea")), f"SELECT path FROM {DOCS} WHERE {has('thintion')} INTERSECT SELECT path FROM {DOCS} WHERE {has('onbleea')}")

# --- lines and snippets
NUMBERED = f"(SELECT path, unnest(string_split(content, chr(10))) AS content, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line FROM {DOCS} WHERE {has('license')}) numbered"
MATCHED = f"(SELECT *, contains(lower(content), 'license') AS is_match FROM {NUMBERED})"


def _licensed(s: SparkSession, d: str) -> DataFrame:
    return postings.located(Engine().match(docs(s, d), "license").hits, [Keyword("license")])


add("grep_lines", lambda s, d: lines.grep(_licensed(s, d)).select("path", "line", "content"), f"SELECT path, line, content FROM {MATCHED} WHERE is_match")
add("grep_context", lambda s, d: lines.grep(_licensed(s, d), before=1, after=2).select("path", "line", "content", "is_match"),
    f"SELECT path, line, content, is_match FROM (SELECT *, max(CAST(is_match AS INTEGER)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS shown FROM {MATCHED}) WHERE shown = 1")
add("grep_limit", lambda s, d: lines.grep(_licensed(s, d), limit=1).select("path", "line"), f"SELECT path, min(line) AS line FROM {MATCHED} WHERE is_match GROUP BY path")
add("grep_gaps", lambda s, d: lines.with_gaps(lines.grep(_licensed(s, d))).select("path", "line", "gap"), f"SELECT path, line, coalesce(line > lag(line) OVER (PARTITION BY path ORDER BY line) + 1, false) AS gap FROM {MATCHED} WHERE is_match")
add("vimgrep", lambda s, d: eng.as_vimgrep(lines.grep(_licensed(s, d))), f"SELECT path || ':' || line || ':' || (strlen(split_part(lower(content), 'license', 1)) + 1) || ':' || content AS value FROM {MATCHED} WHERE is_match")
add("line_scores", lambda s, d: lines.grep(_licensed(s, d)).select("path", "line", (F.size("locs") * lines.PER_MATCH).alias("score")), f"SELECT path, line, 4.0::DOUBLE * ((strlen(content) - strlen(replace(lower(content), 'license', ''))) // 7) AS score FROM {MATCHED} WHERE is_match")
add("best_lines", lambda s, d: _licensed(s, d).select("path", F.inline(lines.best_lines(F.col("content"), F.col("match_locations")))).select("path", "line_number", "content", "score"), None)
add("line_clusters", lambda s, d: _licensed(s, d).select("path", F.posexplode(lines.clusters(F.col("content"), F.col("match_locations"), 3))).select("path", F.col("pos").alias("cluster"), F.size("col").alias("lines")), None)
add("snippets", lambda s, d: _licensed(s, d).select("path", F.inline(snippets.snippets(F.col("content"), F.col("match_locations"), {"license": 100}, 300))).select("path", "start", "end", F.round("score", 6).alias("score"), "content"), None)
add("search_results", lambda s, d: Engine().rendered(Engine().search(docs(s, d), "thintion OR menttre", Options(limit=10))).select("path", F.round("score", 6).alias("score"), F.size("snippets").alias("n")), None)
add("json_results", lambda s, d: eng.as_json(results.top(_scores(s, d, _plain), 5).select("path")), f"SELECT '{{\"path\":\"' || path || '\"}}' AS value FROM (SELECT path FROM {BM25} ORDER BY score DESC, path LIMIT 5)")

add("html_lines", lambda s, d: lines.grep(_licensed(s, d)).select("path", "line", highlight.html(F.col("content"), F.col("locs")).alias("html")), None)

# --- fixtures: what the tables don't hold
SIX = [
    ("src/main/file1.go", "file1.go", "Go", "go", "A brown cat is in the house.", 2),
    ("src/main/file2.go", "file2.go", "Go", "go", "A quick brown dog jumps over the lazy fox.", 5),
    ("pkg/search/file3.py", "file3.py", "Python", "py", "The lazy cat sat on the mat.", 3),
    ("pkg/search/file4.py", "file4.py", "Python", "py", "A bat and a cat are friends.", 8),
    ("vendor/lib/file5.rs", "file5.rs", "Rust", "rs", "This is a complex document about Go programming.", 9),
    ("src/main/file6.txt", "file6.txt", "Text", "txt", "ByteOrderMarks = [][]byte{ {254, 255}, // UTF-16 BE", 1),
]
#: Queries over the six, and which of them (by number) they find.
SIX_CASES = {
    "lazy cat": "3", "cat OR dog": "1 2 3 4", "houss~1": "1", "hovze~2": "1", "zzz~1": "", "254 255": "6", "lang=go,,python": "1 2 3 4", "lang=go,py+thon,java": "1 2", "ext=go,py": "1 2 3 4",
    "(lang=go OR lang=python) AND complexity>=5": "2 4", "cat file:file1": "1", "complexity:<=3": "1 3 6", "complexity:=5": "2", "complexity:!=3": "1 2 4 5 6", "path:SRC/MAIN": "1 2 6",
    'path="src/main"': "1 2 6", "path!=vendor": "1 2 3 4 6", "file:file[34].py": "3 4", "file!=*.go": "3 4 5 6", "file:[invalid": "", "path:*/search/*": "3 4", "NOT path:vendor/*/*": "1 2 3 4 6",
    "lazy AND NOT dog": "3", "NOT lang=go": "3 4 5 6", "cat AND": "1 3 4", "cat)": "1 3 4", "complexity=high": "4 5",
}


def _six(s: SparkSession, d: str) -> DataFrame:
    base = corpus.from_rows(s, SIX)
    out = None
    for case in SIX_CASES:
        found = Engine().match(base, case).hits.select(F.lit(case).alias("query"), "path")
        out = found if out is None else out.unionByName(found)
    return out


_values = ", ".join("('{}', '{}')".format(c, SIX[int(i) - 1][0]) for c, found in SIX_CASES.items() for i in found.split())
add("fixture_queries", _six, f"SELECT query, path FROM (VALUES {_values}) t(query, path)")

CODE = [
    ("a/handler.go", "handler.go", "Go", "go", '// handler comment\nfunc handler() {\n\tmsg := "handler"\n\thandler()\n}\n', 2),
    ("a/handler_test.go", "handler_test.go", "Go", "go", "func TestHandler() {\n\thandler()\n}\n", 1),
    ("b/client.ts", "client.ts", "TypeScript", "ts", "export const client = createClient();\nclient.run();\n", 1),
    ("c/util.py", "util.py", "Python", "py", "def handler():\n    return handler\n", 1),
]


def _code(s: SparkSession, only: str | None, query: str = "handler OR client") -> DataFrame:
    e, o = Engine(), Options(only=only, phrase_boost=False)
    found = e.match(corpus.from_rows(s, CODE), query, o)
    return postings.spans(e.located(found, o)).select("path", "term", "s")


def code_query(name: str, only: str | None, rows: str) -> None:
    add(name, lambda s, d: _code(s, only), f"SELECT * FROM (VALUES {rows}) t(path, term, s)")


code_query("content_code", "code", "('a/handler.go','handler',24), ('a/handler.go','handler',55), ('a/handler_test.go','handler',9), ('a/handler_test.go','handler',22), ('b/client.ts','client',13), ('b/client.ts','client',28), ('b/client.ts','client',38), ('c/util.py','handler',4), ('c/util.py','handler',26)")
code_query("content_comment", "comment", "('a/handler.go','handler',3)")
code_query("content_string", "string", "('a/handler.go','handler',45)")
code_query("decl_declarations", "declarations", "('a/handler.go','handler',24), ('a/handler_test.go','handler',9), ('b/client.ts','client',13), ('c/util.py','handler',4)")
code_query("decl_usages", "usages", "('a/handler.go','handler',3), ('a/handler.go','handler',45), ('a/handler.go','handler',55), ('a/handler_test.go','handler',22), ('b/client.ts','client',28), ('b/client.ts','client',38), ('c/util.py','handler',26)")
add("byte_classes", lambda s, d: corpus.from_rows(s, CODE).select("path", F.inline(byte_classes(F.col("content"), F.col("language")))),
    "SELECT * FROM (VALUES ('a/handler.go',0,18,'comment'), ('a/handler.go',18,44,'code'), ('a/handler.go',44,53,'string'), ('a/handler.go',53,67,'code'), ('a/handler_test.go',0,34,'code'), ('b/client.ts',0,52,'code'), ('c/util.py',0,34,'code')) t(path, s, e, cls)")
BRANCHES = ("d/branch.go", "branch.go", "Go", "go", "// picks\nfunc pick(a int) {\n\n\tif a > 1 {\n\t\tfor {\n\t\t}\n\t}\n}\n", 0)
add("code_stats", lambda s, d: corpus.from_rows(s, [*CODE, BRANCHES]).select("path", code_stats(F.col("content"), F.col("language")).alias("x")).select("path", "x.*"),
    "SELECT * FROM (VALUES ('a/handler.go', 5::BIGINT, 4::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT), ('a/handler_test.go', 3, 3, 0, 0, 0), ('b/client.ts', 2, 2, 0, 0, 0), ('c/util.py', 2, 2, 0, 0, 0), ('d/branch.go', 8, 6, 1, 1, 2)) t(path, lines, code, comment, blank, complexity)")
add("language_of", lambda s, d: s.createDataFrame([("main.go",), ("Makefile",), ("x.PY",), ("a.b.ts",), ("none",), ("odd.qqq",)], "filename string").withColumn("extension", corpus.extension_of("filename")).withColumn("language", corpus.language_of("filename", "extension")),
    "SELECT * FROM (VALUES ('main.go','go','Go'), ('Makefile','','Makefile'), ('x.PY','py','Python'), ('a.b.ts','ts','TypeScript'), ('none','',''), ('odd.qqq','qqq','')) t(filename, extension, language)")
add("levenshtein_bytes", lambda s, d: s.createDataFrame([(a, b, levenshtein_bytes(a, b)) for a, b in (("kitten", "sitting"), ("é", "e"), ("", "abc"), ("same", "same"))], "a string, b string, n long"),
    "SELECT a, b, levenshtein(a, b) AS n FROM (VALUES ('kitten','sitting'), ('é','e'), ('','abc'), ('same','same')) t(a, b)")
TESTS = ("a/tests/x.go", "tests/x.go", "a/x_test.go", "a/x.spec.ts", "a/test_x.py", "a/latest.go", "a/tester.go", "a/x.test", "test")
add("is_test_file", lambda s, d: s.createDataFrame([(p,) for p in TESTS], "path string").withColumn("test", ranking.is_test_file(F.col("path"))),
    "SELECT * FROM (VALUES ('a/tests/x.go',true), ('tests/x.go',false), ('a/x_test.go',true), ('a/x.spec.ts',true), ('a/test_x.py',true), ('a/latest.go',true), ('a/tester.go',false), ('a/x.test',false), ('test',true)) t(path, test)")
add("term_gaps", lambda s, d: corpus.from_rows(s, SIX).select("path", F.inline(ranking.gaps(locate(F.col("content"), [Keyword("lazy"), Keyword("cat"), Keyword("brown")]), ["lazy", "cat", "brown"]))),
    "SELECT path, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(gap AS INTEGER) AS gap FROM (VALUES ('src/main/file1.go',1,2,1), ('src/main/file2.go',0,2,20), ('pkg/search/file3.py',0,1,1)) t(path, a, b, gap)")


def _one_path(s: SparkSession, d: str, limit: int) -> DataFrame:
    """A search of documents of which many have one path."""
    base = docs(s, d).withColumn("path", F.concat("language", F.lit(".txt")))
    found = Engine().search(base, "enein OR enung", Options(ranker="simple", phrase_boost=False, limit=limit))
    return found.select("path", "filename", F.size("match_locations").cast("long").alias("n"))


_count = "CAST((strlen(lower(content)) - strlen(replace(lower(content), '{0}', ''))) / 5 AS BIGINT)".format
add("search_shared_paths", lambda s, d: _one_path(s, d, 0), f"SELECT language || '.txt' AS path, filename, {_count('enein')} + {_count('enung')} AS n FROM {DOCS} WHERE {has('enein')} OR {has('enung')}")
add("search_shared_paths_first", lambda s, d: _one_path(s, d, 1000000), ORACLE["search_shared_paths"])


# --- streams
def _streamed(s: SparkSession, d: str) -> DataFrame:
    """What a stream of the documents matches, once it has read all there is; kept in the folder that executors share."""
    import tempfile
    import uuid

    base = s.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="textloom-")
    base = f"{base}/stream-{uuid.uuid4().hex}"
    source = f"{d}/documents.parquet"
    schema = s.read.parquet(source).schema
    # a pattern, since a stream's path may be a folder or a pattern, but the table may be one file
    found = stream.matches(corpus.documents(stream.read(s, f"{source[:-1]}[t]", schema)), "thintion OR menttre").select("path")
    stream.write(found, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return s.read.schema("path string").parquet(f"{base}/out")


add("stream_match", _streamed, f"SELECT path FROM {DOCS} WHERE {has('thintion')} OR {has('menttre')}")
