"""Cases that break shortcuts: repeated and hot rows, texts that repeat themselves, odd names, whole tables of pages, and scores recomputed word by word."""

import collections
import math
import random
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

SMALL = "/root/testdata/sf0.001"


class Article(HTMLParser):
    """Lines of the article element, by the library's parser: a line ends at every tag that is not inline."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = False, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag == "br":
            self.lines[-1] += " "
        elif tag not in ("b", "i", "a", "em", "span"):
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "span"):
            self.lines.append("")
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


def test_op5_on_the_whole_table(spark):
    from tidewake.llm.registry import QUERIES

    want = {}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        p = Article()
        p.feed(r["html"] or "")
        want[r["page_id"]] = "\n".join(x for x in (" ".join(line.split()) for line in p.lines) if x)
    got = {r["page_id"]: r for r in QUERIES["op5_html_text"](spark, SMALL).collect()}
    assert got.keys() == want.keys()
    assert {k: r["text"] for k, r in got.items()} == want and all(r["n_chars"] == len(want[k]) for k, r in got.items())


def test_wrappers_titles_and_menus():
    from tidewake.llm.html_text import main_text

    long = "Text of the body that goes on for quite some time, with words enough to surge over any bound. " * 3
    want = long.strip()
    assert main_text(f"<div class='content has-sidebar'><p>{long}</p><div class=sidebar>aside</div><p>End.</p></div>") == f"{want}\nEnd."
    assert main_text(f"<div class='post with-comments'><p>{long}</p><div class='comments'><p>{long * 3}</p></div></div>") == want
    assert main_text(f"<div id='page' class='site fixed-header'><p>{long}</p></div><p>tail</p>") == f"{want}\ntail"
    assert main_text(f"<h1>Title</h1><p>Short one.</p><p>{long}</p>") == f"Title\nShort one.\n{want}"
    assert main_text(f"<div class='news-banner'><p>{long}</p></div>") == want  # a compound name on nearly all of the page
    assert main_text("<ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul>") == "" == main_text("<ul><li>Home</li><li>About</li></ul>")


def test_re_pair_goes_on_until_no_pair_pays():
    from tidewake.llm.grammar_store import LEAST, Shard, pack, repair

    r = np.random.default_rng(1)
    phrase = r.integers(0, 50_000, 2000)
    cases = [np.tile(phrase, 60), np.tile(np.arange(20), 20), np.full(5001, 7), np.repeat(np.arange(3), 700), r.integers(0, 30, 4000)]
    for ids in cases:
        ids = ids.astype("<u4")
        ends = np.zeros(len(ids), bool)
        ends[[len(ids) // 3, len(ids) - 1]] = True
        seq, rules, lengths, close = repair(ids, ends)
        last = set(close.tolist())
        seen, pairs = {}, collections.Counter()
        for i in range(len(seq) - 1):  # occurrences that do not overlap
            p = (int(seq[i]), int(seq[i + 1]))
            if i not in last and seen.get(p) != i - 1:
                pairs[p] += 1
                seen[p] = i
        assert max(pairs.values()) < LEAST and len(lengths) == len(rules) and len(close) == 2
    blobs = [x.astype("<u4").tobytes() for x in (phrase, phrase[:3], np.tile(phrase, 5), phrase[:1])]
    s = Shard(pack([5, None, 6, 7], blobs)[0])
    assert [s.document(i).astype("<u4").tobytes() for i in range(4)] == blobs and s.span(2, 1990, 4010).tolist() == np.tile(phrase, 5)[1990:4010].tolist()


def test_texts_that_repeat_themselves_and_short_items():
    from tidewake.llm.decontamination import Benchmark, rolling, tiles

    r = random.Random(3)
    for _ in range(40):
        item = [r.randrange(3) for _ in range(r.randrange(5, 30))]
        doc = [r.randrange(3) for _ in range(80)]
        a, b = np.array(item, np.uint64), np.array(doc, np.uint64)
        assert tiles(a, b, most_seeds=0) == tiles(a, b)
    assert tiles(np.full(1000, 5, np.uint64), np.full(4000, 5, np.uint64)) == [(0, 0, 1000)]
    w = np.array([r.randrange(1 << 60) for _ in range(50)], np.uint64)
    assert (rolling(w, 7)[9:] == rolling(w[9:], 7)).all() and not len(rolling(w[:3], 5))
    b = Benchmark([1, 2, 3], ["Yes, two words", "", None])
    assert [x[0] for x in b.leaks("yes two WORDS.")] == [1] and b.leaks("yes two words more") == [] and b.leaks("yes two") == []


def test_neighbours_of_empty_repeated_and_extreme_vectors(spark):
    from tidewake.llm.neighbours import block_matrix_join

    kind = "vec_id long, embedding array<double>, score string, rank int"
    empty = spark.createDataFrame([], kind)
    assert block_matrix_join(empty, empty).count() == 0
    rows = [(0, [0.0, 0.0]), (0, [1.0, 0.0]), (1, [1e200, 1e200]), (2, [1e-200, 3e-200]), (3, [-5.0, 0.1]), (4, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*x, "s", 1) for x in rows], kind)
    got = block_matrix_join(df, df.filter("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3]
    assert [r["score"] for r in got] == pytest.approx([math.sqrt(0.5), 1 / math.sqrt(10), -5 / math.sqrt(25.01)], abs=1e-12)
    alone = df.filter("vec_id = 1")
    assert block_matrix_join(alone, alone).count() == 0


def test_packing_of_hot_repeated_rows(spark):
    """One row a thousand times: its copies are spread over the blocks."""
    from pyspark.sql import functions as F

    from tidewake.llm.packing import pack

    df = spark.createDataFrame([(None, 0, 0, 5, 1)] * 1000 + [(i, 0, 0, 1000 + i, 2) for i in range(50)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = pack(df, block_items=200)
    assert out.count() == 1050 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_stage_keeps_one_row_of_each(spark):
    """Repeated ids and rows, other columns with odd names."""
    from tidewake.llm.language_crf import keep_identified
    from tidewake.llm.near_copies import keep_one_of_each

    a, b = "one two three four five six seven", "all of these other words are of another text"
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (3, b, "q"), (3, b, "q"), (5, b + " indeed", "w"), (6, b + " and then some more of it all", "v"), (None, a, "n"), (7, "alone in the world", "m"), (7, "alone in the world", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a``b-c` string")
    got = sorted(((r[0], r[1]) for r in keep_one_of_each(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a), (1, b), (6, b + " and then some more of it all"), (None, a), (7, "alone in the world")], key=str)
    with_lang = docs.selectExpr("*", "'en' AS lang", "named_struct('a-b', 1) AS s")
    assert keep_identified(spark, with_lang, "").columns == with_lang.columns and keep_identified(spark, with_lang, "").count() == 10


def test_scores_word_by_word(spark, monkeypatch):
    """The score of a document recomputed from the fitted network by plain loops over its words."""
    from tidewake.llm import gru_lm

    rows = [(i, " ".join(random.Random(i).choice("red green blue white black grey".split()) for _ in range(12)) + f" rare{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, fit = [], gru_lm.fit
    monkeypatch.setattr(gru_lm, "fit", lambda rows, scorer: (fit(rows, scorer), kept.append(scorer))[0])
    monkeypatch.setattr(gru_lm, "KNOWN", 20)  # most rare words have no broadcast count
    got = {r["doc_id"]: r for r in gru_lm.score_documents(docs).collect()}
    s, w = kept[0], kept[0].network.w
    words = {i: [*t.encode().split(), b"\n"] for i, t in rows}
    c = collections.Counter(x for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in ws)
    tail = math.log10(sum(c.values()) - sum(c[x] for x in s.place) + 0.5 * (len(c) - len(s.place) + 1))
    k = s.network.hidden
    sig = lambda v: 1 / (1 + np.exp(-v))
    for i, ws in words.items():
        h, total = np.zeros(k), 0.0
        for x in ws:
            token = s.place.get(x, s.network.words)
            cls, place = (0, 0) if token == s.network.words else (1 + token // s.network.per, token % s.network.per)
            a = h @ w["c"] + w["cb"]
            total += (a[cls] - np.log(np.exp(a).sum())) / math.log(10)
            if cls:
                b = w["o"][cls] @ h + w["ob"][cls]
                total += (b[place] - np.log(np.exp(b).sum())) / math.log(10)
            else:
                total += math.log10(c[x] + 0.5) - tail
            gx, gh = w["x"][token], h @ w["u"]
            z, r = sig(gx[:k] + gh[:k]), sig(gx[k : 2 * k] + gh[k : 2 * k])
            new = np.tanh(gx[2 * k :] + r * gh[2 * k :])
            h = new + z * (h - new)
        assert got[i]["score"] == pytest.approx(total, abs=1e-3), i
        assert got[i]["n_known"] == sum(c[x] > 0 for x in ws)
