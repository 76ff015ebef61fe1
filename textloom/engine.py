"""Search over a DataFrame of documents: from a query to ranked, shaped and rendered results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.languages import DECLARATIONS, PROSE, SYNTAX
from textloom.functions.lexical import annotate
from textloom.functions.matching import term_of
from textloom.operators import lines as line_ops
from textloom.operators import postings as post
from textloom.operators import ranking, results
from textloom.operators import snippets as snippet_ops
from textloom.plans.compile import Compiler, Handler
from textloom.query.nodes import And, Filter, Keyword, Node, Not, Or, Phrase
from textloom.query.parser import AND_DEFAULT, InvalidQueryError
from textloom.query.rewrite import Limits, QueryLimitError, hint_for_no_results, positive, prepared, terms

#: Which matches a search keeps, by the option that says so.
ONLY = ("code", "comment", "string", "declarations", "usages")
RANKERS = ("simple", "tfidf", "tfidf_classic", "bm25", "structural", "minimum")
#: Most distinct terms whose frequency snippets read on the driver: the limit of a query.
MOST_TERMS = 1000
#: Results that are broadcast, as narrow rows, to fetch their content; more are joined as the optimizer sees fit.
MOST_SHOWN = 10_000

#: Languages of which a text's places differ in what they are part of.
LEXIS = sorted({*SYNTAX, *DECLARATIONS})


@dataclass(frozen=True)
class Options:
    sensitive: bool = False
    default_operator: str = AND_DEFAULT
    ranker: str = "structural"
    profile: ranking.Profile = field(default_factory=ranking.Profile)
    weights: ranking.Weights = field(default_factory=ranking.Weights)
    only: str | None = None
    phrase_boost: bool = True
    dedup: bool = False
    limit: int = 0
    offset: int = 0
    limits: Limits = field(default_factory=lambda: Limits(0, 0))
    strict: bool = True
    two_phase: bool = False


class Found(NamedTuple):
    """hits: all matching documents; notices; terms to highlight; tree: what was compiled; query."""

    hits: DataFrame
    notices: list[str]
    terms: list[str]
    tree: Node | None
    query: str


def row_key() -> Column:
    """Tells documents of one path apart."""
    return F.xxhash64("filename", "language", "extension", "complexity", "content")


def _array(columns: list[Column], kind: str) -> Column:
    return F.array(*[c.cast(kind) for c in columns]).cast(f"array<{kind}>")


class Engine:
    """Searches documents (path, filename, language, extension, content, complexity). Further filters and words for numbers can be registered."""

    def __init__(self) -> None:
        self.handlers: dict[str, Handler] = {}
        self.aliases: dict[tuple[str, str], tuple[str, int]] = {}

    def register_filter(self, name: str, handler: Handler) -> None:
        """A handler makes a Column of an operator and a value. A name of the query language takes the place of its own."""
        self.handlers[name.lower()] = handler

    def register_alias(self, field_: str, value: str, operator: str, number: int) -> None:
        self.aliases[(field_.lower(), value.lower())] = (operator, number)

    def match(self, docs: DataFrame, query: str, options: Options = Options()) -> Found:
        """The documents that a query describes. Raises InvalidQueryError for a text without meaning (unless not strict: nothing is found)."""
        tree, notices = prepared(query, options.default_operator, options.limits, self.aliases)
        if tree is None:
            if query and options.strict:
                raise InvalidQueryError(f"invalid query: {query!r}")
            return Found(docs.limit(0), notices, [], None, query)
        compiler = Compiler(options.sensitive, self.handlers)
        hits = docs.where(two_phase(compiler, tree)) if options.two_phase else compiler.filtered(docs, tree)
        return Found(hits, notices, terms(tree), tree, query)

    def located(self, found: Found, options: Options = Options()) -> DataFrame:
        """Hits with their match locations, less those that `only` leaves out; documents that it leaves none of go."""
        nodes = list(positive(found.tree))
        hits = post.located(found.hits, nodes, options.sensitive)
        hits = kept_matches(hits, options.only)
        if options.phrase_boost and (whole := post.phrase_term(found.query)):
            from textloom.functions.matching import locate

            more = F.transform(locate(F.col("content"), [Keyword(whole)], False), lambda x: F.struct(F.lit(found.query).alias("term"), x["s"].alias("s"), x["e"].alias("e")))
            hits = hits.withColumn("match_locations", F.concat("match_locations", more))
        return hits

    def rank(self, docs: DataFrame, found: Found, options: Options = Options(), hits: DataFrame | None = None, keep: tuple[str, ...] = (), scanned: int | None = None) -> DataFrame:
        """path, language, extension, complexity, bytes, score, terms, and the columns to keep, of all hits; not sorted.

        scanned: how many documents were searched, where docs don't hold all of them.
        """
        if options.ranker not in RANKERS:
            raise ValueError(f"no such ranker: {options.ranker} (one of {', '.join(RANKERS)})")
        nodes = list(positive(found.tree))
        names = [term_of(n) for n in post.distinct_nodes(nodes)]
        whole = post.phrase_term(found.query) if options.phrase_boost else None
        if whole and found.query not in names:
            names.append(found.query)
        p = options.profile
        spans_given = hits is not None
        classed = options.ranker in ("structural", "minimum")
        if hits is None:
            hits = self.located(found, options) if options.only or not (classed or post.countable(nodes)) else found.hits
            spans_given = "match_locations" in hits.columns
        if "bytes" not in hits.columns:
            hits = hits.withColumn("bytes", F.octet_length("content").cast("long"))
        rows, counts = hits, lambda: post.frequencies(nodes, names, found.query, whole, options.sensitive)
        if classed:
            weights = options.weights if options.ranker == "structural" else ranking.MinimumProfile().weights
            raised = ranking.MinimumProfile().declaration if options.ranker == "minimum" else 1.0
            near = options.ranker == "minimum"
        if classed and spans_given:
            rows = rows.withColumn("_noted", annotate(F.col("content"), F.col("language"), F.col("match_locations")))
            tf = _array([post.weighted(F.col("_noted"), t, weights.of, raised) for t in names], "double")
            here = _array([post.placed(F.col("match_locations"), t) > 0 for t in names], "boolean")
            gaps = ranking.gaps(F.col("match_locations"), names) if near else F.lit(None)
        elif classed:
            # where nothing is known of a language all places weigh the same: built-in functions tell, and the text isn't sent to Python
            plain = not near and post.countable(nodes)
            alike = ~F.coalesce(F.col("language").isin(*LEXIS), F.lit(False)) if plain else F.lit(False)
            made = ranking.weighed(F.when(~alike, F.col("content")), F.col("language"), post.distinct_nodes(nodes), whole, weights, raised, options.sensitive, near)
            rows = rows.withColumn("_weighed", made)
            tf, here, gaps = F.col("_weighed.tf"), F.col("_weighed.present"), F.col("_weighed.gaps") if near else F.lit(None)
            if plain:
                # of all rows, since Spark lower-cases a text once for all terms only where no condition stands before
                rows = rows.withColumn("_counts", _array(counts(), "double"))
                tf = F.when(alike, F.transform("_counts", lambda x: x * weights.by_class()["code"])).otherwise(tf)
                here = F.when(alike, F.transform("_counts", lambda x: x > 0)).otherwise(here)
        else:
            tf = _array([post.placed(F.col("match_locations"), t) for t in names] if spans_given else counts(), "double")
            here, gaps = None, F.lit(None)
        rows = rows.select("path", "language", "extension", "complexity", "bytes", *keep, tf.alias("tf"), *([here.alias("present")] if here is not None else []), gaps.alias("gaps"))
        if here is None:
            rows = rows.withColumn("present", F.transform("tf", lambda x: x > 0))
        rows = ranking.with_statistics(rows, ranking.statistics(rows, docs, len(names), scanned))
        score = {
            "simple": lambda: F.lit(0.0),
            "tfidf": ranking.tfidf,
            "tfidf_classic": lambda: ranking.tfidf(classic=True),
            "bm25": lambda: ranking.bm25(p.k1, p.b),
            "structural": lambda: ranking.structural(names, p),
            "minimum": lambda: ranking.minimum(),
        }[options.ranker]()
        labels = F.array(*map(F.lit, names)).cast("array<string>")
        own = F.filter(F.zip_with(labels, "present", lambda t, here: F.when(here, t)), lambda t: t.isNotNull())
        out = rows.select("path", "language", "extension", "complexity", "bytes", score.alias("score"), F.array_sort(own).alias("terms"), *keep)
        return ranking.modified(out, p, ranking.has_test_intent(found.query), options.ranker)

    def search(self, docs: DataFrame, query: str, options: Options = Options()) -> DataFrame:
        """Ranked results with their content and match locations, in order; duplicates by matched text left out if asked.

        A row for each result, also where several documents have one path.
        """
        found = self.match(docs, query, options)
        if options.limit <= 0:
            hits = self.located(found, options).withColumn("_row", row_key())
            more = ("filename", "content", "match_locations", "_row")
            return results.top(self._once(self.rank(docs, found, options, hits, more), options), 0, options.offset).drop("_row")
        # narrow rows are ranked; content is fetched, and places are sought in it, for what is shown only
        found = found._replace(hits=found.hits.withColumn("_row", row_key()))
        if options.dedup:
            ranked = self._once(self.rank(docs, found, options, self.located(found, options), ("match_locations", "content", "_row")), options)
            ranked = ranked.drop("match_locations", "content")
        else:
            ranked = self.rank(docs, found, options, keep=("_row",))
        first = results.top(ranked, options.limit, options.offset)
        # documents alike in all columns have one key: they are fetched once and shown as often as they are among the first
        same = [c for c in first.columns if c not in ("path", "_row")]
        first = first.groupBy("path", "_row").agg(*[F.first(c).alias(c) for c in same], F.count("*").cast("int").alias("_times"))
        rest = found.hits.select("path", "_row", "filename", "content")
        rest = rest.join(F.broadcast(first) if options.limit <= MOST_SHOWN else first, ["path", "_row"]).dropDuplicates(["path", "_row"])
        shown = self.located(found._replace(hits=rest), options)
        shown = shown.withColumn("_time", F.explode(F.sequence(F.lit(1), "_times")))
        return results.top(shown.select("path", *same, "filename", "content", "match_locations"))

    def _once(self, ranked: DataFrame, options: Options) -> DataFrame:
        if not options.dedup:
            return ranked
        return results.deduplicated(ranked.withColumn("match_hash", results.match_hash(F.col("content"), F.col("match_locations"))))

    def rendered(self, shown: DataFrame, mode: str = "auto", length: int = 300, surround: int = 2, count: int = 1, before: int = 0, after: int = 0, line_limit: int = 0) -> DataFrame:
        """Results with what of them is shown: lines for code and snippets for prose (auto), or one of lines, snippet, grep."""
        if mode == "grep":
            return line_ops.with_gaps(line_ops.grep(shown, line_limit, before, after))
        counts = shown.select(F.explode("match_locations").alias("x")).groupBy("x.term").count().limit(MOST_TERMS + 1).collect()
        if len(counts) > MOST_TERMS:
            raise QueryLimitError(f"snippets show at most {MOST_TERMS} distinct terms")
        frequency = {r["term"]: r["count"] for r in counts}
        content, places = F.col("content"), F.col("match_locations")
        prose = F.col("extension").isin(*sorted(PROSE)) if mode == "auto" else F.lit(mode == "snippet")
        none = F.expr(f"cast(array() as {snippet_ops.SNIPPETS})"), F.expr(f"cast(array() as array<{line_ops.LINES}>)")
        out = shown.withColumn("snippets", F.when(prose, snippet_ops.snippets(content, places, frequency, length, count)).otherwise(none[0]))
        return out.withColumn("lines", F.when(~prose, line_ops.clusters(content, places, count, surround)).otherwise(none[1]))


def kept_matches(hits: DataFrame, only: str | None) -> DataFrame:
    """Hits with the match locations of one kind: of a class of text, declarations or usages."""
    if only is None:
        return hits
    if only not in ONLY:
        raise ValueError(f"no such kind of match: {only} (one of {', '.join(ONLY)})")
    noted = annotate(F.col("content"), F.col("language"), F.col("match_locations"))
    wanted: dict[str, Callable[[Column], Column]] = {
        "code": lambda x: x["cls"].isin("code", "blank"),
        "comment": lambda x: x["cls"] == "comment",
        "string": lambda x: x["cls"] == "string",
        "declarations": lambda x: x["declares"],
        "usages": lambda x: ~x["declares"],
    }
    left = F.filter("_noted", lambda x: F.coalesce(wanted[only](x), F.lit(False)))
    places = F.transform(left, lambda x: F.struct(x["term"].alias("term"), x["s"].alias("s"), x["e"].alias("e")))
    return hits.withColumn("_noted", noted).withColumn("match_locations", places).drop("_noted").where(F.size("match_locations") > 0)


def two_phase(compiler: Compiler, tree: Node) -> Column:
    """A query as a scan that knows no metadata at first reads it: filters on language and complexity hold in a first pass
    over texts, and texts hold in a second over metadata. An OR of the two is wider than it says, and lists of names filter nothing."""
    late = ("lang", "language", "complexity")

    def first(n: Node | None) -> Column:
        match n:
            case And(a, b):
                return first(a) & first(b)
            case Or(a, b):
                return first(a) | first(b)
            case Not(a):
                return F.lit(True) if only_late(a) else ~first(a)
            case Filter(name, op, value) if name in late or isinstance(value, tuple):
                return F.lit(True)
        return compiler.column(n)

    def second(n: Node | None) -> Column:
        match n:
            case And(a, b):
                return second(a) & second(b)
            case Or(a, b):
                return second(a) | second(b)
            case Not(a):
                return ~second(a) if any_late(a) else F.lit(True)
            case Filter(name, _, _) if name in late:
                return compiler.column(n)
        return F.lit(True)

    def any_late(n: Node | None) -> bool:
        match n:
            case And(a, b) | Or(a, b):
                return any_late(a) or any_late(b)
            case Not(a):
                return any_late(a)
        return isinstance(n, Filter) and n.field in late

    def only_late(n: Node | None) -> bool:
        match n:
            case And(a, b) | Or(a, b):
                return only_late(a) and only_late(b)
            case Not(a):
                return only_late(a)
        return isinstance(n, Filter) and n.field in late

    return first(tree) & second(tree)


def envelope(df: DataFrame, total: int, query: str, offset: int = 0, limit: int = 0) -> dict:
    """Results as a tool call answers them: rows as JSON texts, how many there are, where the next begin, and a hint if there are none."""
    part = results.window(total, offset, limit)
    hint = hint_for_no_results(query) if total == 0 else None
    return {"query": query, "total": total, "returned": part.returned, "truncated": part.truncated, "next_offset": part.next_offset, "hint": hint, "results": as_json(df)}


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def as_vimgrep(lines: DataFrame) -> DataFrame:
    """`path:line:column:content` of matching lines; the column is the first match's byte, from 1."""
    matching = lines.where("is_match")
    return matching.select(F.format_string("%s:%d:%d:%s", "path", "line", F.array_min(F.transform("locs", lambda x: x["s"])) + 1, "content").alias("value"))


def as_text(df: DataFrame) -> DataFrame:
    """A line for each result: path and score."""
    return df.select(F.format_string("%s (%.3f)", "path", "score").alias("value"))


def pages(total: int, current: int = 0, size: int = 20) -> list[dict]:
    """The pages of a result, and which of them is shown."""
    count = results.page_count(total, size)
    current = current if 0 <= current < count else 0
    return [{"number": i, "current": i == current} for i in range(count)]


@contextmanager
def cancellable(spark: SparkSession, name: str) -> Iterator[Callable[[], None]]:
    """Runs what is inside as jobs of one group; calling what it gives, from another thread, stops them."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield lambda: sc.cancelJobGroup(name)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def checked(names: dict, known: set[str]) -> None:
    """Raises TypeError, in order, for parameters that a caller made up."""
    if unknown := sorted(set(names) - known):
        raise TypeError(f"unknown parameters: {', '.join(unknown)}")


__all__ = ["Engine", "Found", "InvalidQueryError", "Keyword", "Options", "Phrase", "as_json", "as_text", "as_vimgrep", "cancellable", "checked", "envelope", "kept_matches", "pages", "term_of", "two_phase"]
