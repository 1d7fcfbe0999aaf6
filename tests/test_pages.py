import pytest

from newsgraph.functions.text import paragraph_text, word_count
from newsgraph.operators import manifest as M, pages as PG
from pyspark.sql import functions as F


@pytest.mark.parametrize("html, want", [
    ("<p>one</p><div>no</div><p class='x'>two <b>three</b>four</p>", "one two three four"),
    ("<p>open<p>next</p>tail", "open next"), ("<P>Up</P>", "Up"), ("<pre>no</pre><param>", ""),
    ("<script>var a='<p>no</p>';</script><p>yes</p>", "yes"), ("<!-- <p>no</p> --><p>a &lt;b&gt; &amp;lt;</p>", "a <b> &lt;"),
    ("<style>p{}</style>text only", ""), ("<p>a<script>x</script>b</p>", "a b"),
    ("<p>1 < 2 and 3</p>", "1 < 2 and 3"), ("<p>x\n\n  y&nbsp;z</p>", "x y z"), ("", ""), (None, ""),
    ("<p>&copy; &#8364;&#x20AC; &#xD800; &unknown; a&b &amp;copy; &eacute;&#39;&apos; AT&T; &</p>",
     "\u00a9 \u20ac\u20ac \ufffd &unknown; a&b &copy; \u00e9'' AT&T; &"),
    ("<script>never closed <p>a</p>", ""), ("<p>a</p >b<p>c", "a c"),
])
def test_paragraph_text(spark, html, want):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(paragraph_text(F.col("html"))).first()[0] == want


def test_word_count(spark):
    texts = ["", " ", "a", " a  b\n", "a b\xa0c", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(word_count(F.col("t"))).collect()] == [
        len((t or "").split()) for t in texts]


def test_outcomes_in_order(spark):
    page = lambda n: "<p>" + "w " * n + "</p>"
    rows = [("1", "", "x", 404, "pdf", page(60), False), ("2", "u", "x", 404, "pdf", page(60), False),
            ("3", "u", "timed out", 404, "pdf", page(60), True), ("4", "u", None, 404, "pdf", page(60), True),
            ("5", "u", None, 200, "application/pdf", page(60), True), ("6", "u", None, 200, "text/html", page(49), True),
            ("7", "u", None, 200, "text/html", page(50), None), ("8", None, None, 200, "text/html", page(50), True),
            ("9", "u", None, None, None, None, True)]
    df = spark.createDataFrame(rows, "Record_ID string, url string, fetch_error string, http_status int, "
                                     "content_type string, html string, allowed boolean")
    got = {r.Record_ID: (r.status, r.word_count, r.reason) for r in PG.fetch_outcome(df).collect()}
    assert got == {
        "1": ("error", 0, "no Source_URL in input row"),
        "2": ("disallowed", 0, "robots.txt disallows this path"),
        "3": ("error", 0, "timed out"), "4": ("error", 0, "HTTP 404"),
        "5": ("error", 0, "non-HTML content-type: application/pdf"),
        "6": ("error", 49, "only 49 words extracted (likely paywall/stub/non-article page)"),
        "7": ("ok", 50, ""), "8": ("error", 0, "no Source_URL in input row"), "9": got["9"]}
    assert got["9"][0] == "error"
    out = PG.fetch_outcome(df)
    assert [r.Record_ID for r in PG.article_texts(out).collect()] == ["7"]
    # page text is cut out once, not again for the filter
    plan = PG.article_texts(out)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("<script") == 1


def test_permission(spark):
    rules = spark.createDataFrame([("A.org", False, "/x", 1), ("a.org", True, "/x/y", 2), ("a.org", False, "", 3),
                                   ("b.org", True, "/", 1), ("b.org", False, "/", 2)],
                                  "host string, allow boolean, path_prefix string, position int")
    urls = {"http://a.org/x/1": (False, False), "http://a.org/x/y?q=1": (True, False), "http://a.org/z": (True, True),
            "http://b.org/": (True, True), "http://b.org": (True, True), "http://c.org/x": (True, True),
            "not a url": (True, True), "": (True, True)}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for i, match in enumerate(("longest", "first")):
        got = {r.url: r.allowed for r in PG.with_permission(df, rules, match).collect()}
        assert got == {u: w[i] for u, w in urls.items()}, match


def test_odd_addresses_do_not_hide_the_host(spark):
    rules = spark.createDataFrame([("h.org", False, "/"), ("under_score.org", False, "/")],
                                  "host string, allow boolean, path_prefix string")
    urls = ["http://h.org/a|b", "http://h.org/a b", "http://h.org/{x}", "http://H.org:8080/x", "http://u:p@h.org/",
            "http://under_score.org/x", "http://h.org?q", "https://h.org#top", "http://h.org/a\nb"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert not any(r.allowed for r in PG.with_permission(df, rules).collect())
    with pytest.raises(ValueError):
        PG.with_permission(df, rules, "first")


def test_gaps_of_required_columns(spark):
    from newsgraph.operators.clean import missing_columns
    df = spark.createDataFrame([("a", None), (" ", 1), ("", None), (None, 2)], "x string, y int")
    assert {tuple(r) for r in missing_columns(df, ["x", "y", "z"]).collect()} == {
        ("x", True, 1, 2), ("y", True, 2, 0), ("z", False, 4, 0)}


def test_repair_keeps_failed_days_due(spark):
    old = spark.createDataFrame([("2023-06-01", "t", "u", 0, "failed"), ("2023-06-02", "t", "u", 0, "failed")],
                                "date string, timestamp_queried string, source_url string, rows_matched long, status string")
    raw = spark.createDataFrame([("20230601121500",)], "DATE string")
    fixed = M.repair_manifest(old, raw)
    assert [(r.date, r.rows_matched, r.status) for r in fixed.collect()] == [("2023-06-01", 1, "ok"), ("2023-06-02", 0, "failed")]
    assert [r.date for r in M.days_to_do(old.select("date"), fixed).collect()] == ["2023-06-02"]


def test_failed_days_are_due_again(spark):
    span = spark.sql("SELECT date'2023-06-01' AS start, date'2023-06-03' AS end")
    days = M.sampled_days(span)
    failed = spark.createDataFrame([("2023-06-02",)], "date string")
    raw = spark.createDataFrame([("20230601121500",)] * 3, "DATE string")
    manifest = M.extraction_manifest(days, raw, failed)
    assert [(r.date, r.rows_matched, r.status) for r in manifest.orderBy("date").collect()] == [
        ("2023-06-01", 3, "ok"), ("2023-06-02", 0, "failed"), ("2023-06-03", 0, "ok")]
    assert [r.date for r in M.days_to_do(days, manifest).collect()] == ["2023-06-02"]
    assert M.days_to_do(days, manifest, legacy=True).count() == 0


def test_repair_keeps_other_days(spark):
    old = spark.createDataFrame([("2023-06-01", "t", "u", 5), ("2023-05-01", "t5", "u5", 0)],
                                "date string, timestamp_queried string, source_url string, rows_matched long")
    raw = spark.createDataFrame([("20230601121500",), ("20230601121500",), ("20230602121500",)], "DATE string")
    got = [(r.date, r.timestamp_queried, r.rows_matched) for r in M.repair_manifest(old, raw).collect()]
    assert got == [("2023-05-01", "t5", 0), ("2023-06-01", "20230601121500", 2), ("2023-06-02", "20230602121500", 1)]


def test_limit_counts_before_the_skip(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(10)], "_pos long, Record_ID string")
    done = spark.createDataFrame([("0",), ("2",)], "Record_ID string")
    assert sorted(r.Record_ID for r in M.records_to_do(rows, done, 4).collect()) == ["1", "3"]
    assert M.records_to_do(rows, done, 0).count() == 8
