"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns."""

import collections
import hashlib
import zlib

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, label int, key long, score string, cid string"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en"), (2, None, "en"), (3, "", "de"), (4, "   \n\t ", None), (5, "!!! 123 ---", "fr"),
    (6, LONG, "en"), (7, "the quick brown fox jumps over the lazy dog again and again", "en"), (8, "word", None), (9, "Übergröße straße über die brücke", "de"),
    (10, "the quick brown fox jumps over the lazy dog again and again", "en"), (10, "the quick brown fox jumps over the lazy dog again and again", "en"),
    (None, "the quick brown fox jumps over the lazy dog again and again", None), (None, None, None), (12, "a b\u0000c ퟿ x", None),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, None, None, "x", 5, None, "y", "z") for r in rows], DOCS)


def write(spark, tmp_path, rows, name="documents"):
    d = str(tmp_path)
    frame(spark, rows).write.mode("overwrite").parquet(f"{d}/{name}.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (None, "x"), (2, None), (3, "")], "item_id long, text string").write.mode("overwrite").parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_document_queries(spark, tmp_path, rows):
    from tidewake.llm.registry import QUERIES

    d = write(spark, tmp_path, rows)
    out = {n: QUERIES[n](spark, d).collect() for n in QUERIES if n[:4] in ("op1_", "op3_", "op4_", "op6_", "op7_", "op8_", "op9_")}
    assert sum(r["n_docs"] for r in out["op1_token_counts"]) == len(rows)
    for n in ("op3_grammar_store", "op4_language_crf", "op6_gru_scores", "op7_setsketch_near"):
        assert collections.Counter(r["doc_id"] for r in out[n]) == collections.Counter(r[0] for r in rows), n
    assert {(r["doc_id"], r["piece"]) for r in out["op8_genetic_packing"] if r["piece"] == 0} == {(r[0], 0) for r in rows}
    if not rows:
        assert not any(out.values())
        return
    starts = sorted((r["start"], r["n_tokens"]) for r in out["op3_grammar_store"])
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    langs = {r["doc_id"]: r for r in out["op4_language_crf"] if r["doc_id"]}
    assert all(langs[i]["lang_pred"] == "und" and langs[i]["score"] == 0 for i in (2, 3, 4, 5)) and langs[1]["lang_pred"] != "und"
    near = collections.defaultdict(list)
    for r in out["op7_setsketch_near"]:
        near[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert near[1] == [(8, 1, True)] and near[7] == [(8, 1, False)] and near[10] == [(8, 1, False)] * 2
    assert near[2] == [(0, 2, True)] and near[3] == [(0, 3, True)] and near[8] == [(1, 8, True)]
    assert sorted(near[None], key=str) == sorted([(8, None, True), (0, None, True)], key=str)
    scores = collections.defaultdict(list)
    for r in out["op6_gru_scores"]:
        scores[r["doc_id"]].append((r["n_tokens"], r["base_score"], r["score"]))
    assert scores[2][0][0] == 1 and len(scores[10]) == 2 and scores[10][0] == pytest.approx(scores[10][1]) and scores[10][0][1:] == pytest.approx(scores[1][0][1:])
    assert {r["doc_id"] for r in out["op9_string_tiling"]} == {1, 7, 10, None} and len(out["op9_string_tiling"]) == 5


PAGE = "<html><body><nav><a href=/>home</a></nav>%s<footer>end</footer></body></html>"


def test_page_queries(spark, tmp_path):
    from tidewake.llm.registry import QUERIES

    big, same = "x" * 2_000_000, PAGE % ("<article><p>" + "same text " * 120 + "</p></article>")
    rows = [(1, "u", None), (2, "u", ""), (3, None, same), (4, "v", same), (9, "w", same), (9, "w", same), (5, "s", "short"), (6, "s", "short"), (None, "n", same), (7, "l", big), (8, "z", PAGE % "<p>Tiny.</p>")]
    spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op2_warc_normalise"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((x[2] or "") for x in rows if x[0] == r["page_id"])
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        want = ("revisit", 9) if html == same and r["page_id"] != 9 else ("response", None)
        assert (r["record_type"], r["refers_to"]) == want
    texts = {r["page_id"]: r["text"] for r in QUERIES["op5_html_text"](spark, str(tmp_path)).collect()}
    assert texts[1] == texts[2] == "" and texts[9] == ("same text " * 120).strip() and len(texts[7]) == 2_000_000 and texts[8] == "Tiny."
    empty = f"{tmp_path}/none"
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{empty}/pages.parquet")
    assert QUERIES["op2_warc_normalise"](spark, empty).count() == 0 and QUERIES["op5_html_text"](spark, empty).count() == 0


def test_warc_normaliser_round_trip():
    from tidewake.llm.warc import normalise, open_record, record_bytes, records

    rs = [record_bytes(i, f"http://x/{i}", (f"<p>{i}</p>\r\n\r\n" * i).encode(), "d" * 40, "response" if i % 3 else "revisit", 99) for i in range(40)]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = b"".join(map(c.compress, rs)) + c.flush()
    archive, index = normalise(whole)
    assert list(records(whole, piece=7)) == rs == list(records(archive))
    for i, e in enumerate(index):
        head, block = open_record(archive, e)
        assert head["x-page-id"] == str(i) and block == ((f"<p>{i}</p>\r\n\r\n" * i).encode() if i % 3 else b"")
    with pytest.raises(Exception):
        list(records(whole[: len(whole) // 2]))


def test_main_text_cases():
    from tidewake.llm.html_text import main_text

    body = "".join(f"<p>Sentence {i} of the long article, with enough words to count &amp; more.</p>" for i in range(6))
    want = "\n".join(f"Sentence {i} of the long article, with enough words to count & more." for i in range(6))
    assert main_text(f"<div class='menu'><a>A</a><a>B</a></div><div class=content>{body}</div><div id='comments'><p>{'I think so. ' * 40}</p></div><div class='footer'>f</div>") == want
    assert main_text(f"<header><h1>Site</h1></header><main>{body}</main><aside>{'side ' * 80}</aside><form><input><p>{'form ' * 50}</form>") == want
    assert main_text(f"<nav><ul><li><a>x</a></ul><article><h1>T</h1>{body}<script>var a='<p>';</script><section class='comments'>{body}</section></article>") == "T\n" + want
    assert main_text("<article><p>a\n  b&nbsp;c</p><!-- <p>no</p> --><p> d<br>e </p></article>") == "a b c\nd e"
    assert main_text("<div class='cookie-notice'>We use cookies</div><p>Short.</p>") == "Short."


def test_main_text_is_not_lost_around_removed_elements():
    from tidewake.llm.html_text import main_text

    long, end = "word " * 60 + "long.", "The closing paragraph is sixty characters long or about so."
    ad = "<div class=ad>buy this</div>"
    assert main_text(f"<p>{long}</p>{ad}<p>{end}</p>") == f"{long}\n{end}"
    assert main_text(f"<h1>Head</h1><div class=share>x</div><p>{long}</p>") == f"Head\n{long}"
    assert main_text(f"<p class=notice>gone<p>{long}<p>{end}") == f"{long}\n{end}"
    assert main_text(f"<ul><li class=share>gone<li>{long}</ul><p>{end}</p>") == f"{long}\n{end}"
    assert main_text(f"<ul><li class=share>gone<ul><li>gone</ul></ul><p>{long}</p>") == long
    assert main_text(f"<p>{long}</p><p>{long}</p><article>A short teaser</article>").startswith(f"{long}\n{long}")


def plain_pipeline(spark, d):
    """The stages' decisions by plain code; language ID is taken from the operator (it is a learned model)."""
    from tests.llm.test_brute_force import components_of, plain_tiles, shingles
    from tidewake.llm.language_crf import keep_identified

    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in keep_identified(spark, docs, d).collect()}
    sets = {i: shingles(t) for i, t in kept.items()}
    comp = components_of(sets)
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    norm = lambda t: [w for w in ("".join(filter(str.isalnum, x)) for x in (t or "").lower().split()) if w]
    items = [norm(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = {}
    for i, t in kept.items():
        w = norm(t)
        seeds = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        near = [b for b in items if len(b) >= 5 and any(tuple(b[k : k + 5]) in seeds for k in range(len(b) - 4))]
        if not any(sum(x[2] for x in plain_tiles(b, w)) >= 0.6 * len(b) for b in near):
            clean[i] = t
    return clean


def test_pipeline(spark):
    import corpus_pipeline
    from tests.llm.test_brute_force import SMALL

    rows = corpus_pipeline.run(spark, SMALL).collect()
    want = plain_pipeline(spark, SMALL)
    assert {r["doc_id"] for r in rows} == set(want) and 100 < len(want)
    by = collections.defaultdict(int)
    for r in rows:
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= 4096


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    assert {r["doc_id"] for r in corpus_pipeline.run(spark, write(spark, tmp_path / "odd", ROWS)).collect()} >= {6, 9}
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "none", [])).count() == 0
