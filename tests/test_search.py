"""Searches on Spark: the documents found, scores, lines, snippets, results and streams."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom import engine as eng
from textloom.engine import Engine, InvalidQueryError, Options
from textloom.functions.matching import locate
from textloom.operators import lines, postings, ranking, results, snippets
from textloom.query.nodes import Keyword
from textloom.query.rewrite import QueryLimitError, positive
from textloom.query.rewrite import Limits
from textloom.queries import CODE, SIX
from textloom.session import BATCH_BYTES, BATCH_ROWS
from textloom.sources import corpus
from textloom.streaming import stream

PATHS = [r[0] for r in SIX]
#: query, whether case counts, the documents found by number.
CASES = [
    ("cat", False, "134"), ("lazy cat", False, "3"), ("cat OR dog", False, "1234"), ("cat NOT house", False, "34"), ('"lazy cat"', False, "3"), ("/[cb]at/", False, "134"), ("complexity>=8", False, "45"),
    ("complexity<=3", False, "136"), ("complexity=5", False, "2"), ("complexity=2,5", False, "12"), ("complexity!=3", False, "12456"), ("complexity<3", False, ""), ("lang=go", False, "12"), ("lang=go,py", False, "12"),
    ("lang=go,python", False, "1234"), ("lang!=go", False, "3456"), ("lang>=go", False, "3456"), ("Cat", False, "134"), ("cat", True, "134"), ("Cat", True, ""), ("lang=go,,python", False, "1234"), ("lang=,go,python", False, "1234"),
    ("lang=go,python,", False, "1234"), ("ext=py", False, "34"), ("ext=go,py", False, "1234"), ("lang=go,py+thon,java", False, "12"), ("lang=go NOT python", False, "12"), ("(lang=go OR lang=python) AND complexity>=5", False, "24"),
    ("lang=GO,PYTHON", False, "1234"), ("254 255", False, "6"), ("houss~1", False, "1"), ("zzz~1", False, ""), ("houss~1 AND brown", False, "1"), ("hovze~2", False, "1"), ("cat file:file1", False, "1"), ("cat ext:go", False, "1"),
    ("cat lang:go", False, "1"), ("complexity:<=3", False, "136"), ("complexity:>=8", False, "45"), ("cat complexity:<=3", False, "13"), ("complexity:=5", False, "2"), ("complexity:!=3", False, "12456"), ("complexity:5", False, ""),
    ("path:src/main", False, "126"), ("path:pkg/search", False, "34"), ("path=vendor", False, "5"), ("cat path:pkg/search", False, "34"), ("path!=vendor", False, "12346"), ("path:SRC/MAIN", False, "126"), ('path="src/main"', False, "126"),
    ("filepath=vendor", False, "5"), ("file:*.go", False, "12"), ("file:*_test.go", False, ""), ("file:file?.go", False, "12"), ("file:file?.py", False, "34"), ("file:file[34].py", False, "34"), ("file:*.GO", False, "12"),
    ("file!=*.go", False, "3456"), ("file:[invalid", False, ""), ("file!=[invalid", False, "123456"), ("path:*/search/*", False, "34"), ("path:src/main/*", False, "126"), ("path:vendor/*/*", False, "5"), ("NOT path:vendor/*/*", False, "12346"),
    ("path:SRC/MAIN/*", False, "126"), ("cat path:*/search/*", False, "34"), ("file:file1", False, "1"), ("brown NOT path:vendor", False, "12"), ("cat NOT path:vendor", False, "134"), ("lazy cat NOT path:vendor", False, "3"),
    ("lazy AND NOT dog", False, "3"), ("NOT lang=go", False, "3456"), ("/(/", False, ""), ('""', False, "123456"), ("complexity=high", False, "45"), ("file=1", False, ""), ("foo/bar", False, ""),
]


@pytest.fixture(scope="module")
def six(spark):
    return corpus.from_rows(spark, SIX).cache()


@pytest.fixture(scope="module")
def code(spark):
    return corpus.from_rows(spark, CODE).cache()


def test_documents_found(six):
    out = None
    for i, (query, sensitive, _) in enumerate(CASES):
        hits = Engine().match(six, query, Options(sensitive=sensitive)).hits.select(F.lit(i).alias("case"), "path")
        out = hits if out is None else out.unionByName(hits)
    found: dict[int, set] = {i: set() for i in range(len(CASES))}
    for r in out.collect():
        found[r.case].add(r.path)
    for i, (query, _, want) in enumerate(CASES):
        assert found[i] == {PATHS[int(n) - 1] for n in want}, query


def test_errors_and_limits(six):
    for query in ("AND", ">", "OR", "NOT", "lang=", "lang>>5", ","):
        with pytest.raises(InvalidQueryError):
            Engine().match(six, query)
        assert Engine().match(six, query, Options(strict=False)).hits.count() == 0
    assert Engine().match(six, "").hits.count() == 0
    with pytest.raises(QueryLimitError):
        Engine().match(six, "a b", Options(limits=Limits(100, 1)))
    with pytest.raises(ValueError):
        Engine().rank(six, Engine().match(six, "cat"), Options(ranker="none"))
    with pytest.raises(ValueError):
        Engine().search(six, "cat", Options(only="prose"))
    with pytest.raises(TypeError, match="a, b"):
        eng.checked({"b": 1, "a": 2, "q": 3}, {"q"})


def test_filters_come_in_order_of_cost(six):
    plan = Engine().match(six, "/x/ AND cat AND lang=go").hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("lower(language") < plan.index("cat") < plan.index("(?d)x")


def test_registered(six):
    e = Engine()
    e.register_filter("lang", lambda op, v: F.startswith("path", F.lit(v)))
    e.register_alias("complexity", "tiny", "<=", 2)
    assert sorted(r.path for r in e.match(six, "lang:src complexity=tiny").hits.collect()) == [PATHS[0], PATHS[5]]


def _score(spark, column, **values):
    row = {"path": "a.go", "complexity": 0, "bytes": 10, "score": 1.0} | values
    df = spark.createDataFrame([tuple(row.values())], "path string, complexity bigint, bytes bigint, score double")
    return df.select(column).first()[0]


def test_modifiers(spark):
    score, path, c, b = (F.col(x) for x in ("score", "path", "complexity", "bytes"))
    terms = lambda *t: F.array(*map(F.lit, t))
    boost = lambda p, *t: _score(spark, ranking.filename_boost(score, path, terms(*t)), path=p)
    assert boost("pkg/rank.go", "rank") == 2.0
    assert boost("pkg/ranker.go", "rank") == 1.6
    assert boost("pkg/rank.go", "rank", "index") == 1.5
    assert boost("sort/sort.go", "sort") == pytest.approx(4.2)
    assert boost("a/b.go", "zzz") == 1.0
    damp = lambda intent: _score(spark, ranking.test_dampening(score, path, 0.4, intent), path="auth_test.go", score=5.0)
    assert damp(False) == 2.0 and damp(True) == 7.5
    assert _score(spark, ranking.gravity(score, c, 0.0), complexity=10, score=5.0) == 5.0
    assert _score(spark, ranking.gravity(score, c, 1.0), complexity=10, score=5.0) == pytest.approx(5 * (1 + math.log(11)))
    assert 0 < _score(spark, ranking.noise(score, c, b, 1.0), bytes=1_000_000, score=5.0) < 5
    assert _score(spark, ranking.noise(score, c, b, 100.0), bytes=1_000_000, score=5.0) == 5.0
    assert _score(spark, ranking.length_bias(score, b, 0.3), bytes=1000) == pytest.approx(1 / 1.9)
    located = lambda p, s, *t: _score(spark, ranking.location(score, path, terms(*t)), path=p, score=s)
    assert located("a/cat.go", 1.0, "cat") == pytest.approx((1 + 0.15 * 3) / (1 + 2 * 0.02))
    assert located("a/cat.go", 0.0, "cat") == pytest.approx(0.01 * (1 + 0.15 * 3) / (1 + 2 * 0.02))
    assert located("cat/dog", 1.0, "cat", "dog") == pytest.approx((1 + 0.45) * (1 + 0.45) / (1 + 4 * 0.02) * 1.3)
    assert located("x", 1.0, "cat") == 1.0
    assert ranking.has_test_intent("find Mock server") and not ranking.has_test_intent("mocking")
    assert ranking.profile("precise").k1 == 0.3 and ranking.profile(None, "brain", "raw") == ranking.Profile(gravity=2.5, noise=100.0)


def _bm25(tf, df, n, words, avg, k1=1.2, b=0.75):
    return math.log10(1 + n / df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * words / avg))


FLAT = ranking.Profile(1.2, 0.75, 0.0, 100.0, 1.0, 0.0)


def _ranked(docs, query, **options):
    o = Options(profile=FLAT, phrase_boost=False, **options)
    return {r.path: r.score for r in Engine().rank(docs, Engine().match(docs, query, o), o).collect()}


def test_base_rankers(six):
    words = {r[0]: max(1, len(r[4]) // 2) for r in SIX}
    hit = PATHS[:4]
    avg = sum(words[p] for p in hit) / 4
    want = {p: sum(_bm25(r[4].lower().count(t), df, 6, words[p], avg) for t, df in (("cat", 3), ("dog", 1)) if t in r[4].lower()) for p, r in zip(hit, SIX, strict=False)}
    # neither term stands in the paths, so that modifiers change nothing
    assert _ranked(six, "cat OR dog", ranker="bm25") == pytest.approx(want)
    assert _ranked(six, "cat OR dog", ranker="structural") == pytest.approx(want)
    classic = {p: sum(r[4].lower().count(t) / words[p] * math.log10(6 / df) for t, df in (("cat", 3), ("dog", 1))) for p, r in zip(hit, SIX, strict=False)}
    assert _ranked(six, "cat OR dog", ranker="tfidf_classic") == pytest.approx(classic)
    assert set(_ranked(six, "cat OR dog", ranker="simple").values()) == {0.0}
    # fuzzy terms are counted by their places
    assert list(_ranked(six, "houss~1", ranker="bm25")) == [PATHS[0]]


def test_structural_and_minimum(spark, code):
    by = _ranked(code, "handler", ranker="structural")
    weight = {"a/handler.go": 0.2 + 1 + 0.5 + 1, "a/handler_test.go": 2.0, "c/util.py": 2.0}
    size = {r[0]: len(r[4].encode()) // 2 for r in CODE}
    avg = sum(size[p] for p in weight) / 3
    flat = {p: _bm25(w, 3, 4, size[p], avg) for p, w in weight.items()}
    for p, want in flat.items():
        # the path names the term: location and file name raise it
        assert by[p] >= want * 0.99
    docs = [("x/a.go", "a.go", "Go", "go", "func handler func func func func", 1), ("x/b.go", "b.go", "Go", "go", "func handler handler handler xxx", 1)]
    got = _ranked(corpus.from_rows(spark, docs), "func OR handler", ranker="structural")
    assert got["x/b.go"] > got["x/a.go"]
    only_common = _ranked(corpus.from_rows(spark, docs), "func", ranker="structural")
    assert only_common["x/a.go"] > only_common["x/b.go"]
    near = [("n/1", "1", "", "", "alpha beta" + " x" * 40, 1), ("n/2", "2", "", "", "alpha" + " x" * 40 + " beta", 1), ("n/3", "3", "", "", "alpha" + " x" * 42 + "   ", 1)]
    got = _ranked(corpus.from_rows(spark, near), "alpha OR beta", ranker="minimum")
    assert got["n/1"] > got["n/2"] > 0
    n, size = 3, 45
    a, b = _bm25(1, 3, n, size, 45), _bm25(1, 2, n, size, 45)
    assert got["n/1"] == pytest.approx(0.9 * min(a, b) * (1 + 1.5 / (1 / 6 + 1)) + 0.1 * (a + b) / 2, rel=1e-2)
    assert got["n/3"] == pytest.approx(_bm25(1, 3, n, len(near[2][4]) // 2, 45), rel=1e-2)


def test_weighed_without_lists_of_places(spark, code, sf):
    """Ranking by what a text's places weigh gives what lists of all places give, to the last bit."""
    prose = corpus.documents(spark.read.parquet(f"{sf}/documents.parquet"))
    odd = [("o/1", "1", "", "", "Σ İ Handler\u0130 handler", 1), ("o/2", "2", "en", "txt", "", 1), ("o/3.go", "3.go", "Go", "go", "/* é handler */ handler client", 1)]
    both = code.unionByName(prose).unionByName(corpus.from_rows(spark, odd)).coalesce(1).cache()
    queries = ("handler OR client OR thintion", "/[Hh]andler?/ OR the OR handler", '"return handler" OR thintion menttre', "handlor~1 OR thintion", "lang:Go", "lang:en the")
    for ranker, weights in (("structural", ranking.Weights()), ("structural", ranking.Weights(only="comment")), ("minimum", ranking.Weights())):
        rows = [None, None]
        for query in queries:
            o = Options(ranker=ranker, weights=weights, profile=FLAT)
            found = Engine().match(both, query, o)
            for i, hits in enumerate((None, Engine().located(found, o))):
                one = Engine().rank(both, found, o, hits).select(F.lit(query).alias("query"), "path", "terms", "score")
                rows[i] = one if rows[i] is None else rows[i].unionByName(one)
        got, want = (sorted(map(tuple, r.collect())) for r in rows)
        assert got == want, (ranker, weights)


def test_structural_leaves_prose_out_of_python(spark):
    docs = spark.sql("SELECT 'a/1.txt' AS path, '1.txt' AS filename, 'en' AS language, 'txt' AS extension, cast(X'616C70686120FF20416C706861' AS string) AS content, 0L AS complexity")
    # a byte that is no UTF-8 can't be read in Python
    assert _ranked(docs, "alpha", ranker="structural") == pytest.approx({"a/1.txt": _bm25(2, 1, 1, 6, 6)})


def test_searches_send_few_texts_at_once(spark):
    own = spark.newSession()
    base = own.createDataFrame([("alpha " * 2000,)] * 3, "content string").select("content", F.explode(F.sequence(F.lit(1), F.lit(1500))))  # 54 MB

    @F.pandas_udf("struct<n:long,size:long>")
    def batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n": len(texts), "size": texts.str.len().sum()}, index=texts.index)

    try:
        locate(F.col("content"), [Keyword("alpha")])
        most = base.repartition(1).select(batch("content").alias("x")).agg(F.max("x.n"), F.max("x.size")).first()
    finally:
        spark.createDataFrame([(1,)], "x int")  # the session of the other tests is active again
    assert most[0] <= BATCH_ROWS
    assert most[1] <= BATCH_BYTES + 12_000


def test_gaps():
    spans = [{"term": t, "s": s, "e": e} for t, s, e in (("a", 0, 50), ("a", 60, 61), ("b", 10, 12), ("b", 70, 75), ("c", 200, 201))]
    assert ranking.gaps_of(spans, ["a", "b", "c"]) == [{"a": 0, "b": 1, "gap": 0}, {"a": 0, "b": 2, "gap": 139}, {"a": 1, "b": 2, "gap": 125}]


@pytest.mark.parametrize(("only", "starts"), [("code", [24, 55]), ("comment", [3]), ("string", [45]), ("declarations", [24]), ("usages", [3, 45, 55])])
def test_kept_matches(code, only, starts):
    o = Options(only=only)
    rows = Engine().search(code, "handler path:handler.go", o).collect()
    assert [[x.s for x in r.match_locations] for r in rows] == [starts]


def test_phrase_boost(six):
    o = Options(ranker="bm25")
    terms = {r.path: r.terms for r in Engine().rank(six, Engine().match(six, "lazy cat", o), o).collect()}
    assert terms == {PATHS[2]: ["cat", "lazy", "lazy cat"]}


def test_two_phase(six):
    paths = lambda q: sorted(PATHS.index(r.path) + 1 for r in Engine().match(six, q, Options(two_phase=True)).hits.collect())
    assert paths("dog OR lang:go") == [1, 2, 3, 4, 5, 6]
    assert paths("ext=go,py") == [1, 2, 3, 4, 5, 6]
    assert paths("cat lang:go") == [1]
    assert paths("NOT (cat lang:go)") == [5, 6]
    assert paths("NOT lang=go") == [3, 4, 5, 6]


def _hit(spark, content, terms, extension="go"):
    df = corpus.from_rows(spark, [("p", "p", "", extension, content, 0)])
    return postings.located(df, [Keyword(t) for t in terms])


def _shown(df):
    return [r.line for r in df.orderBy("line").collect()]


def test_grep(spark):
    seven = "\n".join(["a", "b", "c", "d", "hit", "f", "g"])
    hit = lambda text, *terms: _hit(spark, text, terms or ("hit",))
    assert _shown(lines.grep(hit(seven), before=2, after=2)) == [3, 4, 5, 6, 7]
    assert _shown(lines.grep(hit("hit\nb\nhit\nd\ne"), before=1, after=1)) == [1, 2, 3, 4]
    assert _shown(lines.grep(hit("a\nhit\nc\nd\nhit\nf\ng"), before=1, after=1)) == [1, 2, 3, 4, 5, 6]
    assert _shown(lines.grep(hit("hit\nb"), before=3)) == [1]
    assert _shown(lines.grep(hit("hit\nhit\nhit"), limit=2)) == [1, 2]
    assert _shown(lines.grep(hit("a\nb\nc\nhit\ne\nf"), before=2)) == [2, 3, 4]
    assert _shown(lines.grep(hit("a\nhit\nc\nd\ne"), after=2)) == [2, 3, 4]
    assert _shown(lines.grep(hit("a\nyear\nab", "a", "year"))) == [2]
    r = lines.grep(hit("x\r\né hit\r\n")).first()
    assert (r.line, r.content, [(x.s, x.e) for x in r.locs]) == (2, "é hit", [(3, 6)])
    assert [r.gap for r in lines.with_gaps(lines.grep(hit("hit\nb\nhit"))).orderBy("line").collect()] == [False, True]
    assert [r.value for r in eng.as_vimgrep(lines.grep(hit("a\nx hit"))).collect()] == ["p:2:3:x hit"]


def test_best_lines_and_clusters():
    text = "\n".join(f"hit {i}" if i in (5, 15, 25) else f"line {i}" for i in range(1, 31)).encode()
    places = []
    at = text.find(b"hit")
    while at >= 0:
        places.append({"term": "hit", "s": at, "e": at + 3})
        at = text.find(b"hit", at + 1)
    assert [x["line_number"] for x in lines.best_lines_of(text, places)] == [3, 4, 5, 6, 7, 13, 14, 15, 16, 17, 23, 24, 25, 26, 27]
    groups = lines.clusters_of(text, places, 3)
    assert [[x["line_number"] for x in g] for g in groups] == [[3, 4, 5, 6, 7], [13, 14, 15, 16, 17], [23, 24, 25, 26, 27]]
    assert len(lines.clusters_of(text, places, 9)) == 3 and lines.clusters_of(text, [], 2) == []
    short = b"a\nb a\nthe year\n"
    found = lines.best_lines_of(short, [{"term": "a", "s": 0, "e": 1}, {"term": "year", "s": 10, "e": 14}], 0)
    assert [(x["line_number"], x["score"]) for x in found] == [(3, 4.0)]


def test_snippets():
    text = (b"word " * 100) + b"needle in hay " + (b"word " * 100)
    at = text.find(b"needle")
    got = snippets.snippets_of(text, [{"term": "needle", "s": at, "e": at + 6}], {"needle": 1}, 60)
    assert len(got) == 1 and "needle" in got[0]["content"] and len(got[0]["content"]) < 90
    # one match, near itself, spaces on both sides, in its case
    assert got[0]["score"] == 1 + 100 + 5 + 5 + 5
    assert text[got[0]["start"] : got[0]["end"]].decode() == got[0]["content"]
    assert got[0]["locs"] == [{"s": at - got[0]["start"], "e": at + 6 - got[0]["start"]}]
    many = [{"term": "word", "s": i * 5, "e": i * 5 + 4} for i in range(100)]
    apart = snippets.snippets_of(text, many, {"word": 200}, 50)
    spans = sorted((x["start"], x["end"]) for x in apart)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert snippets.snippets_of("é".encode() * 50, [{"term": "é", "s": 50, "e": 52}], {}, 20)[0]["content"].strip("é") == ""
    assert snippets.marked("a<b> hit", [{"s": 5, "e": 8}]) == "a&lt;b&gt; <strong>hit</strong>"


def test_results(spark):
    rows = [(f"p{i:02d}", float(i % 7), "h" if i % 3 == 0 else "") for i in range(25)]
    df = spark.createDataFrame(rows, "path string, score double, match_hash string")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r.path for r in results.top(df, 5, 3).collect()] == [r[0] for r in order[3:8]]
    assert [r.path for r in results.page(df, 1, 20).orderBy("rank").collect()] == [r[0] for r in order[20:]]
    assert [r.path for r in results.page(df, 9, 20).orderBy("rank").collect()] == [r[0] for r in order[:20]]
    assert results.page_count(20, 10) == 2 and results.page_count(25, 20) == 2
    kept = {r.path: r.duplicate_count for r in results.deduplicated(df).collect()}
    best = min((r for r in rows if r[2]), key=lambda r: (-r[1], r[0]))[0]
    assert len(kept) == 16 + 1 and kept[best] == 8
    assert results.duplicate_locations(df).count() == 8
    assert results.window(30, 0, 5) == results.Slice(30, 5, True, 5)
    assert results.window(30, 25, 5) == results.Slice(30, 5, False, None)
    assert "TakeOrderedAndProject" in results.top(df, 5, 3)._jdf.queryExecution().executedPlan().toString()


def test_search_and_rendering(six, code):
    top = Engine().search(six, "cat OR dog", Options(limit=2))
    assert top.count() == 2 and {"content", "match_locations", "score", "terms"} <= set(top.columns)
    shown = Engine().rendered(Engine().search(code, "handler", Options(dedup=True)))
    assert all(r.lines and not r.snippets for r in shown.collect())
    answer = eng.envelope(top.select("path"), 4, "cat OR dog", 0, 2)
    assert (answer["total"], answer["returned"], answer["next_offset"], answer["hint"]) == (4, 2, 2, None)
    assert "ANDed" in eng.envelope(top.limit(0), 0, "aaa bbb")["hint"]
    assert eng.pages(25, 1) == [{"number": 0, "current": False}, {"number": 1, "current": True}] and eng.pages(0) == []
    with eng.cancellable(six.sparkSession, "one") as stop:
        assert six.count() == 6 and callable(stop)
    assert eng.as_text(top).first()[0].endswith(")")


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src" / "a.go").write_text("package a // é\n")
    (tmp_path / "src" / "b.py").write_text("x = 1\n")
    (tmp_path / "src" / "bin.go").write_bytes(b"a\0b")
    (tmp_path / "src" / "min.go").write_text("x" * 600)
    (tmp_path / "src" / "empty.go").write_text("")
    (tmp_path / "src" / ".hidden.go").write_text("h\n")
    (tmp_path / ".git" / "c.go").write_text("g\n")
    (tmp_path / "src" / "bad.go").write_bytes(b"ok \xff\xfe\n")
    names = lambda **o: sorted(r.filename for r in corpus.files(spark, str(tmp_path), **o).collect())
    assert names() == ["a.go", "b.py", "bad.go"]
    assert names(extensions=["py"]) == ["b.py"]
    assert names(languages=["Python"]) == ["b.py"]
    assert names(binary=True, minified=True) == ["a.go", "b.py", "bad.go", "bin.go", "min.go"]
    assert names(ignore=["*.py"], exclude=["bad"]) == ["a.go"]
    r = corpus.files(spark, str(tmp_path), extensions=["go"], exclude=["bad", "min"], most=9).first()
    assert (r.language, r.content, r.bytes) == ("Go", "package a", 9)
    (tmp_path / "src" / "branch.go").write_text("// if for\n" * 20 + "func f() {\n\tif a {\n\t\tfor b {\n\t\t}\n\t}\n}\n")
    (tmp_path / "src" / "plain.txt").write_text("if\n" * 7)
    got = {r.filename: (r.complexity, r.language) for r in corpus.files(spark, str(tmp_path), extensions=["go", "txt"]).collect()}
    assert got["branch.go"] == (2, "Go") and got["plain.txt"][0] == 7 and got["a.go"][0] == 0
    assert corpus.repository_root(str(tmp_path / "src")) == str(tmp_path)
    docs = corpus.from_rows(spark, SIX + [("many", "many", "", "", "1\n2\n3\n4", 0)])
    assert [tuple(x) for x in corpus.file_lines(docs, "many", 2, 3).collect()] == [(2, "2"), (3, "3")]
    assert corpus.file_lines(docs, "many", 3, 99).count() == 2
    with pytest.raises(ValueError):
        corpus.file_lines(docs, "../etc", 1, 2)
    with pytest.raises(ValueError):
        corpus.file_lines(docs, "many", 3, 2)


def test_streams(spark, six, tmp_path):
    six.write.parquet(str(tmp_path / "in"))
    docs = stream.read(spark, str(tmp_path / "in"), six.schema, files_at_once=1)
    stream.write(stream.matches(docs, "cat"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [PATHS[2], PATHS[3], PATHS[0]]
    seen = []
    stream.ranked(docs, "cat OR dog", str(tmp_path / "kept"), str(tmp_path / "cp2"), lambda df, n: seen.append({r.path for r in df.collect()}), Options(ranker="bm25")).awaitTermination()
    assert seen[-1] == set(PATHS[:4])
    scores = []
    o = Options(ranker="bm25")
    stream.ranked(docs, "cat OR dog", str(tmp_path / "kept2"), str(tmp_path / "cp3"), lambda df, n: scores.append({r.path: r.score for r in df.collect()}), o).awaitTermination()
    assert scores[-1] == pytest.approx({r.path: r.score for r in Engine().rank(six, Engine().match(six, "cat OR dog", o), o).collect()})


@pytest.mark.parametrize("limit", [0, 3, 10])
@pytest.mark.parametrize("dedup", [False, True])
def test_documents_of_one_path(spark, limit, dedup):
    rows = [("p", "p", "", "txt", "cat", 0), ("p", "p", "", "txt", "dog cat cat", 0), ("p", "p", "", "txt", "cat", 0), ("q", "q", "", "txt", "some Cat", 0), ("r", "r", "", "txt", "none", 0)]
    got = Engine().search(corpus.from_rows(spark, rows), "cat", Options(limit=limit, dedup=dedup, ranker="bm25")).collect()
    scores = {r.content: r.score for r in got}
    if dedup:
        assert len(got) == 3 and sorted(r.duplicate_count for r in got) == [0, 0, 1] and len(scores) == 3
    else:
        assert sorted(r.content for r in got) == (["cat", "cat", "dog cat cat"] if limit == 3 else ["cat", "cat", "dog cat cat", "some Cat"])
        assert scores["dog cat cat"] != scores["cat"]
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert all(len(r.match_locations) == r.content.lower().count("cat") for r in got)


def test_postings(six):
    found = Engine().match(six, "cat OR house")
    tf = postings.term_frequencies(found.hits, list(positive(found.tree)))
    assert {(r.term, r.df) for r in postings.document_frequency(tf).collect()} == {("cat", 3), ("house", 1)}
    assert {(r.term, r.ctf) for r in postings.corpus_frequency(tf).collect()} == {("cat", 3), ("house", 1)}
