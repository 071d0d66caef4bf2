import math

import pytest
from pyspark.sql import functions as F

from gatewright.functions.html import html_to_text, visible_text
from gatewright.functions.sections import MIN_SECTION_CHARS, extract_all
from gatewright.functions.text import expanding_idf, pair_cosine, pair_tfidf, term_bags, term_counts, tokens
from gatewright.operators.signals import cosine_distance, novelty, tone


def cosine(spark, a, b):
    docs = spark.createDataFrame([(1, a), (2, b)], "id int, text string")
    pairs = spark.createDataFrame([(1, 2)], "a int, b int")
    return pair_cosine(pairs, term_counts(docs, "id", "text"), "id").first().score


def test_tokens(spark):
    got = spark.createDataFrame([("Café a b2b The THE x-ray",)], "t string").select(tokens(F.col("t"))).first()[0]
    assert got == ["caf", "the", "the", "ray"]


def test_cosine(spark):
    same = "net sales rose and costs fell while margins held"
    assert cosine(spark, same, same) == pytest.approx(1.0)
    assert 0 < cosine(spark, same, "net sales fell and risks rose") < 1
    assert cosine(spark, "alpha beta", "gamma delta") == 0.0
    assert cosine(spark, same, "   ") is None and cosine(spark, "12 34", "56") is None
    assert cosine(spark, same, "rose fell") == pytest.approx(cosine(spark, "rose fell", same))


def test_idf_needs_enough_earlier_rows_and_ignores_the_future(spark):
    def idf(n_old, n_rare, later=()):
        docs = [(i, "common rare" if i < n_rare else "common", 2000) for i in range(n_old)] + [(900, "common rare", 2001)] + list(later)
        df = spark.createDataFrame(docs, "id int, text string, year int")
        counts = term_counts(df, "id", "text")
        found = expanding_idf(counts, df.select("id", "year", F.lit(True).alias("fits")), "id").where("year = 2001")
        return {r.term: r.idf for r in found.collect()}

    assert idf(49, 49) == {}
    assert idf(50, 4).keys() == {"common"} and idf(50, 5).keys() == {"common", "rare"}
    assert idf(50, 5)["rare"] == pytest.approx(math.log(51 / 6) + 1)
    assert idf(60, 7) == idf(60, 7, [(901, "rare rare common", 2002), (902, "rare", 2001)])


def test_terms_of_earlier_years_have_weights_in_years_without_them(spark):
    """What a filing drops still counts against its likeness to the one before."""
    docs = [(i, "common gone" if i < 30 else "common", 2000) for i in range(60)] + [(900, "common", 2002), (901, "common", 2005)]
    df = spark.createDataFrame(docs, "id int, text string, year int")
    counts = term_counts(df, "id", "text")
    found = expanding_idf(counts, df.select("id", "year", F.lit(True).alias("fits")), "id")
    assert {(r.year, r.term): r.idf for r in found.collect()} == pytest.approx(
        {(2002, "common"): 1.0, (2002, "gone"): math.log(61 / 31) + 1, (2005, "common"): 1.0, (2005, "gone"): math.log(62 / 31) + 1}
    )
    pair = spark.createDataFrame([(900, 3, 2002)], "a int, b int, year int")
    assert pair_tfidf(pair, counts, found, "id").first().score == pytest.approx(1 / math.hypot(1, math.log(61 / 31) + 1))


def test_tfidf_pair(spark):
    docs = [(i, "common rare" if i % 2 else "common", 2000) for i in range(60)] + [(900, "common rare", 2001), (901, "common", 2001)]
    df = spark.createDataFrame(docs, "id int, text string, year int")
    counts = term_counts(df, "id", "text")
    pairs = spark.createDataFrame([(900, 901, 2001), (900, 901, 2000)], "a int, b int, year int")
    got = {r.year: r.score for r in pair_tfidf(pairs, counts, expanding_idf(counts, df.select("id", "year", F.lit(True).alias("fits")), "id"), "id").collect()}
    common, rare = math.log(61 / 61) + 1, math.log(61 / 31) + 1
    assert got[2000] is None and got[2001] == pytest.approx(common / math.hypot(common, rare))


LONG = "word " * 300


def bodies(spark, text, names=("item_7",)):
    return extract_all(spark.createDataFrame([(text,)], "t string"), "t", names).first()


CONTENTS = "Item 1A. Risk 4\nItem 1B. Comments 9\nItem 7. Discussion 12\nItem 7A. Market 20\nItem 8. Statements 30\n"


def test_the_body_is_found_behind_the_contents(spark):
    text = CONTENTS + f"Item 1A. Risk\nrisky {LONG}\nItem 1B. Comments\nnone\nItem 7. Discussion\ntalk {LONG}\nItem 7A. Market\nx\nItem 8. Statements\n"
    r = bodies(spark, text)
    assert not r.section_failed and r.body.startswith("Discussion\ntalk") and "risky" not in r.body and "30" not in r.body
    both = bodies(spark, text, ("item_1a", "item_7"))
    assert both.body == bodies(spark, text, ("item_1a",)).body + "\n\n" + r.body


def test_missing_headings_fail_and_never_return_the_text(spark):
    r = bodies(spark, "no headings " * 300, ("item_1a", "item_7"))
    assert r.section_failed and "item_1a" in r.failure_reason and "; " in r.failure_reason and r.body == ""
    assert bodies(spark, None).section_failed


def test_a_follower_named_only_in_the_contents_still_ends_the_section(spark):
    r = bodies(spark, CONTENTS + f"Item 7. Discussion\n{LONG}\nItem 8. Statements\n")
    assert r.section_failed and "fewer" in r.failure_reason


def test_without_a_follower_it_runs_to_the_end(spark):
    assert bodies(spark, f"Item 7. Discussion\n{LONG}").body.endswith("word")


@pytest.mark.parametrize("n, failed", [(MIN_SECTION_CHARS - 1, True), (MIN_SECTION_CHARS, False)])
def test_shortest_section(spark, n, failed):
    assert bodies(spark, "Item 7\n" + "x" * n + "\nItem 8\n").section_failed is failed


def test_equal_spans_take_the_earliest(spark):
    r = bodies(spark, "Item 7\n" + "a" * 1200 + "\nItem 8\n" + "Item 7\n" + "b" * 1200 + "\nItem 8\n")
    assert set(r.body) == {"a"}


def test_heading_forms(spark):
    for head in ("ITEM 7—", "  item 7:", "Item7 -", "\tItem 7"):
        assert not bodies(spark, f"x\n{head} Discussion\n{LONG}\nItem 8\n").section_failed, head
    assert bodies(spark, f"x\rItem 7 Discussion {LONG}\nItem 8\n").section_failed  # not after a bare return
    assert bodies(spark, f"see Item 7 above {LONG}\nItem 8\n").section_failed


def test_label_7_also_begins_7a(spark):
    r = bodies(spark, f"Item 7A first\n{LONG}\nItem 8\n")
    assert r.section_failed  # 7A is both the nearest start and the chosen end


def test_edges_are_stripped_of_all_white_space(spark):
    assert bodies(spark, f"Item 7\n   {LONG}  \nItem 8\n").body == LONG.strip()


def test_pairs_meet_as_bags_without_a_row_for_each_term(spark):
    texts = [(1, "a bb bb CC dd"), (1, "bb ee"), (2, "bb cc cc"), (3, None), (4, "1 2"), (5, "zz")]  # two rows of 1 are one document
    docs = spark.createDataFrame(texts, "id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (2, 3), (4, 2), (5, 2), (6, 1)], "a long, b long")
    want = 5 / math.sqrt(12) / math.sqrt(5)
    for counts in (term_bags(docs, "id", "text"), term_counts(docs, "id", "text")):
        got = sorted((r.a, r.b, r.score) for r in pair_cosine(pairs, counts, "id").collect())
        assert [g[:2] for g in got] == [(1, 2), (1, 2), (2, 1), (2, 3), (4, 2), (5, 2), (6, 1)]
        assert [g[2] for g in got] == [pytest.approx(want)] * 3 + [None, None, 0.0, None]
    for name in ("lazy_cosine", "lazy_build", "signal_build"):
        from gatewright.plans.queries import QUERIES

        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(regexp_extract_all" not in plan, name


def test_weights_meet_the_distinct_terms_of_blocks(spark):
    """200 equal texts: their entries, 30 for each, never move, only the 30 terms of a block and year do."""
    from gatewright.functions.text import weighed

    seen = lambda rows, weights: rows.select(["id", "year"]).append_column("n", [[len(weights.get(y.as_py(), {})) for y in rows.column("year")]])
    docs = spark.range(200).selectExpr("id", "CAST(2000 + id % 2 AS INT) AS year", "array_join(transform(sequence(1, 30), i -> concat('t', char(96 + i % 26 + 1), char(96 + CAST(i / 26 AS INT) + 1))), ' ') AS bag")
    idf = docs.where("id < 1").selectExpr("2001 AS year", "explode(split(bag, ' ')) AS term", "1.5D AS idf")
    got = weighed(docs, idf, "id", seen, "id long, year int, n long").collect()
    assert len(got) == 200 and {(r.year, r.n) for r in got} == {(2000, 0), (2001, 30)}


PAGE = (
    "<?xml version='1.0' encoding='ascii'?><html><head><style>p{x:1}</style><title>t</title></head><body><ix:header><ix:hidden>secret</ix:hidden></ix:header>"
    "<div style='Display: None'>gone</div>kept<p hidden>also gone</p><p><b>Item 7.</b> Manag&eacute;ment &amp; more<!-- note --> tail<table><tr><td>Sales</td><td><ix:nonFraction>1,234</ix:nonFraction></td></tr>"
    "<tr><td>Costs</td><td>9</td></tr></table><script>var a = '</p>';</script>end</body></html>"
)


def test_cut_references_stay_as_they_stand():
    assert visible_text("<p>so &amp; &amp;&amp\n<p>and &quo &amp") == "so & &&amp\n\nand &quo &amp"
    assert visible_text("<p>&notit; &#65; &#x42; &#67 &middot; a&b; &lt;") == "&notit; A B &#67 · a&b; <"


def test_visible_text():
    text = visible_text(PAGE)
    lines = text.split("\n")
    assert "Item 7. Managément & more tail" in lines and "Sales 1,234" in lines and "Costs 9" in lines and "kept" in lines and "end" in lines
    for absent in ("secret", "gone", "p{x", "var a", "note", "xml"):
        assert absent not in text
    assert "\n\n\n" not in text


def test_unclosed_and_deep_markup():
    assert visible_text("<p>one<p>two<b>three") == "one\n\ntwothree"
    assert visible_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert visible_text("a<span hidden>b</span>c<br/>d<p style='visibility:hidden'>e<div>f</div>") == "ac\n\nd\nf"


def test_blank_pages_are_errors(spark):
    with pytest.raises(ValueError):
        visible_text("  \n")
    got = html_to_text(spark.createDataFrame([("a", "<p>x</p>"), ("b", " "), ("c", None)], "accession string, html string"), "accession", "html")
    assert {r.accession: (r.text, r.error is None) for r in got.collect()} == {"a": ("x", True), "b": (None, False), "c": (None, False)}


def test_signals(spark):
    docs = spark.createDataFrame([(1, "bad bad good"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: (r.n_terms, r.n_hits, r.rate) for r in tone(docs, spark.createDataFrame([("bad",)], "term string"), "id", "text").collect()}
    assert got == {1: (3, 2, pytest.approx(2 / 3)), 2: (0, 0, None), 3: (0, 0, None)}
    texts = spark.createDataFrame([(1, "We sell. We grow!"), (2, "we  sell. We shrink."), (3, "")], "id int, text string")
    pairs = spark.createDataFrame([(2, 1), (3, 2)], "a int, b int")
    assert {r.a: (r.n_sentences, r.n_new, r.novel_share) for r in novelty(pairs, texts, "id", "text").collect()} == {2: (2, 1, 0.5), 3: (0, 0, None)}
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>")
    assert v.select(cosine_distance(F.col("a"), F.col("b")), cosine_distance(F.col("a"), F.col("a")), cosine_distance(F.col("a"), F.col("c"))).first()[:] == (1.0, 0.0, None)


def test_a_text_with_100000_headings_takes_linear_time(spark):
    """Headings in turn, the longest section last but one; two sections over one pass of marks."""
    import time

    text = "Item 7. a\nItem 8. b\n" * 50_000 + f"Item 7. last\n{LONG}\nItem 8\nItem 7"
    bodies(spark, "warm")
    began = time.perf_counter()
    r = bodies(spark, text, ("item_1a", "item_7"))
    assert time.perf_counter() - began < 2
    assert r.body == f"last\n{LONG.strip()}" and r.section_failed and "item_1a" in r.failure_reason


def test_sections_equal_a_plain_search(spark):
    """Every end with its nearest start, over texts of random headings and fillings."""
    import random
    import re

    r = random.Random(3)
    parts = ["Item 7", "Item 7A.", "item 8 -", "ITEM 1A:", "Item 1B", "Item 2", "Item 20x", "see Item 7", "", "ü" * 40, "w" * 1200, " \titem 7 — y"]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randint(0, 14))) + r.choice(["", "\n"]) for _ in range(300)]

    def plain(text, label, followers):
        heads = lambda lab, tail: [(m.start(), m.end()) for m in re.finditer(rf"(?im)^[ \t]*item[ \t ]*{lab}{tail}", text)]
        starts = [e for _, e in heads(label, r"[ \t]*[.:\-–—]?[ \t]*")]
        ends = next((own for f in followers if (own := [s for s, _ in heads(f, "")])), [len(text)])
        spans = [(e - max(s for s in starts if s < e), -e, max(s for s in starts if s < e)) for e in ends if any(s < e for s in starts)]
        piece = text[max(spans)[2] : max(spans)[2] + max(spans)[0]].strip() if spans else ""
        return piece if len(piece) >= MIN_SECTION_CHARS else ""

    df = spark.createDataFrame([*enumerate(texts)], "i int, t string")
    for name, label, followers in (("item_7", "7", ("7A", "8")), ("item_1a", "1A", ("1B", "1C", "2"))):
        got = {x.i: x.body for x in extract_all(df, "t", (name,)).collect()}
        want = {i: plain(t, label, followers) for i, t in enumerate(texts)}
        assert got == want and sum(map(bool, want.values())) > 20
