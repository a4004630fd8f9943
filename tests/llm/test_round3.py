"""Operators 11 to 13: against brute force, and odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from runloom.llm import pages, repair, whitening
from runloom.llm.pages import main_text

TURNS = "conv_id long, turn long, role string, text string, present boolean, kind string, copy int"


def cheapest(turns):
    """The least (cost, audit) and what it gives, by trying all edits in order of cost and letters."""
    seen, flags = set(), []
    for role, text in turns:
        blank = re.search(r"[^\x20\x09-\x0D]", text) is None
        again = (role, text) in seen
        cut = not blank and not again and re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) is None
        flags.append((blank, again and not blank, cut))
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, out = heapq.heappop(heap)
        if (at, initials, audit) in done or not re.fullmatch("s?(ua)*u?", initials):
            continue
        done.add((at, initials, audit))
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", initials):
            return flags, cost, audit, out
        if len(initials) < 2 * len(turns) + 2:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 2, audit + "I", at, initials + role[0], (*out, (role, ""))))
        if at < len(turns):
            (role, text), (blank, again, cut) = turns[at], flags[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, initials, out))
            if not blank and not again:
                if role:
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, initials + role[0], (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + cut + 2, audit + "R", at + 1, initials + new[0], (*out, (new, text))))


def test_repair_is_the_cheapest_edit(spark):
    draw = random.Random(3)
    rows, want = [], {}
    for c in range(400):
        n = draw.choice([0, 1, 1, 2, 3, 4, 5])
        turns = sorted((t, draw.choice(["user", "assistant", "system", "tool", "uncle", ""]), draw.choice(["a.", "b?", "no end", " \t", "", "x. ", "Ünd!"])) for t in [draw.randrange(7) for _ in range(n)])
        rows += [(c, *t, True, "x", 0) for t in turns] or [(c, 5, "user", "gone.", False, "x", 0)]
        want[c] = ([(r, x) for _, r, x in turns], [t for t, _, _ in turns])
    got = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, TURNS).repartition(3), present=repair.F.col("present")).collect()}
    assert len(got) == len(want)
    for c, (turns, numbers) in want.items():
        flags, cost, audit, out = cheapest(turns)
        r = got[c]
        assert (r["cost"], r["audit"], [tuple(x) for x in r["repaired"]]) == (cost, audit, list(out)), turns
        assert [r["blank"], r["duplicate"], r["truncated"]] == [sum(f[i] for f in flags) for i in range(3)]
        assert r["illegal"] == sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:], strict=False))
        assert r["gaps"] == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)


def test_repair_of_odd_rows(spark):
    rows = [(None, 0, "user", "q?", True, "x", 0), (None, None, "user", "first.", True, "x", 0), (1, None, None, None, True, "x", 0), (2, 3, "user", "only " * 9_000 + ".", True, "x", 0), (2, 3, "user", "only " * 9_000 + ".", True, "x", 1)]
    rows += [(3, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.", True, "x", 0) for i in range(3_000) if i != 1_500]
    got = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, TURNS)).collect()}
    assert [t["text"] for t in got[None]["repaired"]] == ["first.", "q?"] and got[None]["audit"] == "KR" and got[None]["gaps"] == 0
    assert (got[1]["audit"], got[1]["blank"], got[1]["illegal"], got[1]["repaired"]) == ("D", 1, 0, [])
    assert (got[2]["audit"], got[2]["cost"], got[2]["duplicate"]) == ("KDI", 5, 1)
    assert (got[3]["audit"], got[3]["cost"], got[3]["gaps"]) == ("K" * 1_500 + "I" + "K" * 1_499, 2, 1)
    assert repair.repair(spark.createDataFrame([], TURNS)).count() == 0


def test_damage_is_by_the_checksum(spark):
    rows = [(c, t, None if c % 7 == 0 else "assistant", None if t == 3 else f"a. b! {c}?") for c in range(40) for t in [None, 0, 1, 2, 3]]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    key = lambda r: (r[0], -1 if r[1] is None else r[1], r[2], r[3])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)


def test_op11_sql_with_nulls_and_repeated_turns(spark, tmp_path):
    draw = random.Random(5)
    rows = [(draw.choice([None, *range(60)]), draw.choice([None, *range(9)]), draw.choice([None, "user", "assistant", "system"]), draw.choice([None, "", "a.", "b!", "c", "d? "])) for _ in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_conversation_repair(spark, str(tmp_path)).toPandas()
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = c.sql(repair.OP11_SQL).df()
    rows = lambda t: sorted(map(str, t[sorted(t.columns)].astype(object).where(t.notna(), None).values.tolist()))
    norm = lambda t: t.assign(conv_id=t["conv_id"].astype("Int64"))
    assert rows(norm(got)) == rows(norm(want))
    assert hashlib.sha256(b"").hexdigest() in set(got["repaired_sha256"]) or len(got)


def whitened_by_numpy(vectors):
    sound = [v for v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(256 * np.array(sound, dtype="float64")).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vs = np.linalg.eigh(centred.T @ centred / n)
    values, vs = values[::-1][:4], vs[:, ::-1][:, :4]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vs / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("d", [2, 5, 17])
def test_whitening_is_numpys(spark, d):
    draw = np.random.default_rng(d)
    vectors = (draw.normal(size=(300, d)) * np.arange(1, d + 1)).astype("float32").astype(float).tolist()
    vectors += [vectors[0]] * 200 + [None, [], [None, *[1.0] * (d - 1)], [float("nan")] * d, [float("inf"), *[0.0] * (d - 1)], [0.5] * (d + 1)]
    rows = [(i if i else None, v, "label") for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").repartition(5)).collect()
    n, deviation, whitened, explained = whitened_by_numpy(vectors[:-6])
    some = min(4, d)
    assert len(got) == 500 * some and {r["n"] for r in got} == {n} == {300} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by = {(r["vec_id"] or 0, r["component"]): r for r in got}
    assert [by[i, 1]["deviation"] for i in range(500)] == deviation.tolist()
    for k in range(some):
        own = np.array([by[i, k + 1]["whitened"] for i in range(500)])
        assert np.allclose(own * np.sign(own @ whitened[:, k]), whitened[:, k]) and np.isclose(by[0, k + 1]["explained"], explained[k])


def test_whitening_of_odd_rows(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, -0.0]), (2, [0.5, 0.0])], kind)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], kind)).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True, 3: True} and flat[0]["identity_error"] < 1e-9
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [1e17, 3.0])], kind)).collect()
    assert len(far) == 6 and {r["deviation"] for r in far} == {None}


CHROME = {
    "nav": "<nav><ul><li><a href='/a'>Home</a></li></ul></nav>",
    "menu": "<div class='main-menu'><a href='/b'>All, of, our, many, sections</a></div>",
    "header": "<header class='site-header'><h1>The Site</h1><p>News, views, and more, every day.</p></header>",
    "aside": "<aside><p>Aside, with, many, commas, and, much, text.</p></aside>",
    "sidebar": "<div id='left-sidebar'><p>Sidebar, with, many, commas, and, much, text.</p></div>",
    "cookie": "<div class='cookieNotice'><p>We use cookies, trackers, and more, to serve you.</p></div>",
    "ad": "<div class='ad'>Buy, now, cheap, things, today.</div>",
    "form": "<form action='/s'><label>Your name, please</label><input name=x><select><option>One<option>Two</select></form>",
    "script": "<script>var x = '<p>no, no, no</p>';</script><style>p{}</style><noscript>Turn it on.</noscript>",
    "comments": "<section id='comments'><h2>Comments</h2><article class='comment'><p>I think, therefore, I, comment, at, length, here.</p></article></section>",
    "remark": "<!-- <p>never, shown, at, all</p> -->",
    "footer": "<footer><p>&copy; The Site, all rights, and wrongs, reserved.</p></footer>",
}
BODY = "<h1>Of <i>Cats</i> &amp; Dogs</h1><p>Cats,   dogs,\nand&nbsp;mice.<p>Second <b>para</b>graph<br>goes on, here.</p><ul><li>one<li><a href='#'>two</a></ul><table><tr><td>x<td>y<tr><th>z</table><blockquote>Said &quot;so&quot; &#233;.</blockquote><p>End"
TEXT = 'Of Cats & Dogs Cats, dogs, and mice. Second paragraph goes on, here. one two x y z Said "so" é. End'


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article class='post has-sidebar'>{}</article></main>", "<div class='wrap'><div id='content'>{}</div></div>", "<div role='main'>{}</div>", "<form id='page'>{}</form>", "<table><tr><td>{}</td></tr></table>"])
def test_pages_keep_the_article_alone(wrap):
    before = "".join(CHROME[k] for k in ("header", "nav", "menu", "cookie", "ad", "aside", "remark", "script"))
    after = "".join(CHROME[k] for k in ("sidebar", "form", "comments", "footer"))
    inside = BODY + CHROME["ad"] + CHROME["script"]
    whole = f"<!DOCTYPE html><html><head><title>T, t, t</title></head><body class='no-sidebar'>{before}{wrap.format(inside)}{after}</body></html>"
    if "form" in wrap:
        whole = f"<html><body><form id='page'>{before}<div id='content'>{inside}</div>{CHROME['footer']}</form></body></html>"
    assert main_text(whole) == TEXT


def test_sections_are_siblings():
    assert main_text("<div><div class='row'><p>One, two, three, and a long way to go.</p></div><div class='row'><p>Two.</p></div><div><a href='/'>Three</a></div></div>") == "One, two, three, and a long way to go. Two."
    assert main_text("<article><p>Part, one, of, two, with, more.</p></article><article><p>Part, two, of, two, with, more.</p></article>") == "Part, one, of, two, with, more. Part, two, of, two, with, more."
    assert main_text("<article><h1>Only a title</h1></article>") == "Only a title"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        (" \n ", ""),
        ("plain", "plain"),
        ("1 < 2 & 3 &amp;lt; 4", "1 < 2 & 3 &lt; 4"),
        ("<p>cut &am", "cut &am"),
        ("<p>cut <b", "cut"),
        ("<p>a</x></div></p>b", "a b"),
        ("<script>x", ""),
        ("<!-- x", ""),
        ("<div hidden>no</div><p data-x='hidden' class=overflow-hidden>yes</p>", "yes"),
        ("<div>" * 30_000 + "deep, down" + "</div>" * 30_000, "deep, down"),
        ("<b>" * 30_000 + "</i>" * 30_000 + "x", "x"),
        ("<article>" + "<p>word, word.</p>" * 20_000, " ".join(["word, word."] * 20_000)),
    ],
)
def test_odd_pages(source, want):
    assert main_text(source) == want


def test_page_rows(spark):
    rows = [(1, "u", None, "x", 7), (None, None, "<p>Null key.</p>", "x", 7), (2, "v", "<p>Twice.</p>", "x", 7), (2, "v", "<p>Twice.</p>", "x", 7)]
    kind = "page_id long, url string, html string, text string, n_chars int"
    got = sorted((tuple(r) for r in pages.extract(spark.createDataFrame(rows, kind)).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (None, None, "Null key.", 9), (2, "v", "Twice.", 6), (2, "v", "Twice.", 6)], key=str)
    assert pages.extract(spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize("k", [20_000, 80_000])
def test_a_settled_group_and_an_outsider_make_pairs_in_proportion(spark, k):
    """One bucket of k documents in one component and one document of another: k open pairs, and no more are made."""
    from runloom.llm import neardup

    F = repair.F
    buckets = spark.range(k + 1).select(F.lit(7).cast("long").alias("bucket"), "id", F.lit(100).cast("long").alias("n"), F.lit(k + 1).cast("long").alias("c"))
    least = spark.range(k).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("least"))
    seen = []

    def confirmed(pairs):
        seen.append(pairs.count())
        return pairs.where("a = 5")

    got = neardup.rest_of_buckets(buckets, least, None, confirmed).collect()
    assert seen == [k] and [(r["a"], r["b"]) for r in got] == [(5, k)]


def test_language_sample_by_text_and_language(spark):
    """Rows that share an id, null too, don't stand or fall together, and many languages have their share each."""
    from runloom.llm import language

    rows = [(None, f"the thing number {i} and more", "en") for i in range(1000)] + [(5, f"word {i}", "de") for i in range(300)] + [(i, f"le chose {i}", "fr") for i in range(20)] + [(7, "egal", "es")] * 500
    got = language.labelled_sample(spark.createDataFrame(rows, "id long, text string, lang string").repartition(7))
    assert set(got) == {"en", "de", "fr", "es"} and got["es"] == " egal " and len(got["en"]) > 400
    draw = random.Random(1)
    words = {f"l{k:03d}": ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(60)] for k in range(200)}
    train = [(i, " ".join(draw.choices(v, k=12)), k) for k, v in words.items() for i in range(30)]
    t = spark.createDataFrame(train, "id long, text string, lang string")
    tests = [(i, " ".join(draw.choices(v, k=20)), k) for i, (k, v) in enumerate(words.items())]
    out = {r["doc_id"]: r["lang_pred"] for r in language.detect(spark.createDataFrame(tests, "doc_id long, text string, lang string"), t).collect()}
    assert sum(out[i] == k for i, _, k in tests) >= 198


def test_contamination_of_null_texts_without_ansi(spark):
    from runloom.llm import decontaminate

    docs, items = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.contamination(docs, items).collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)
    assert got == {1: (0, 0), 2: (2, 1)}
