"""Every operator against a plain version on small tables."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


ODD = ["", "a  b", "  x", "x ", "\n\na b\n", "don't it's 'S we've", "a b c", "12 3456 a1b2", "<|endoftext|> x<|endoftext|>y", "É ÀÇ ß ÿ µ º ª x", "a\tb", "tab \t c", "　漢字 ok", "é e ́x", "x\n\ny z.\n!", "!!?? ¿que? #$%&'()", "\r\n a", "x\x1c y", "İI ΑΣ ΑΣ. Σ", "²³ ½ a²", "…“q” — –", "a _b_ c__d", "1st 2nd's", "\n", " ", "x\ny", "x \ny"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, texts):
    from tidewake.llm.encode import encoder

    e, t = encoder(name), tokenizer(name)
    r = random.Random(1)
    mixed = ["".join(r.choice(["a", "B", "é", " ", "  ", "\n", ".", "'s", "1", "\t", "ß", "_", "漢", "-"]) for _ in range(30)) for _ in range(400)]
    for x in ODD + mixed + list(texts.values()):
        assert np.frombuffer(e.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x[:80]


def test_encoder_memory_is_bounded():
    from tidewake.llm.encode import Encoder
    import public_tokenizers

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"), spaced=True, most=40)
    t = tokenizer("byte_bpe_50k.json")
    x = " ".join(f"word{i} thing{i % 7}." for i in range(300))
    assert np.frombuffer(e.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert len(e.after) + len(e.after.old) <= 41


def test_op1(spark, texts):
    from tidewake.llm.registry import QUERIES

    t = tokenizer("byte_bpe_50k.json")
    n = sorted(len(t.encode(x or "", add_special_tokens=False).ids) for x in texts.values())
    got = {r["context_limit"]: r for r in QUERIES["op1_token_counts"](spark, SMALL).collect()}
    assert sorted(got) == sorted(set(n))
    for limit, r in got.items():
        kept = sum(min(x, limit) for x in n)
        assert (r["n_docs"], r["fits"], r["total_tokens"], r["tokens_kept"], r["tokens_lost"]) == (n.count(limit), sum(x <= limit for x in n), sum(n), kept, sum(n) - kept)
        assert r["quantile"] == pytest.approx(r["fits"] / len(n))


def test_op1_helpers(spark):
    from tidewake.llm.token_counts import length_histogram, length_quantiles, truncated_totals

    h = length_histogram(spark.createDataFrame([(x,) for x in (0, 3, 3, 2000, 5000)], "n_tokens long"))
    assert truncated_totals(h, [3, 4096]).first() == (12, 3 + 3 + 2000 + 4096)
    assert {r["share"]: r["n_tokens"] for r in length_quantiles(h, [0.2, 0.5, 1.0]).collect()} == {0.2: 0, 0.5: 3, 1.0: 5000}


def test_op3(spark, texts):
    from tidewake.llm.registry import QUERIES

    t, start, want = tokenizer("byte_bpe_50k.json"), 0, {}
    for d in sorted(texts):
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op3_grammar_store"](spark, SMALL).collect()} == want


def test_grammar_round_trip_and_spans():
    from tidewake.llm.grammar_store import Shard, pack

    r = np.random.default_rng(3)
    phrases = [r.integers(1, 50000, 6) for _ in range(20)]
    docs = [np.concatenate([*(phrases[i] for i in r.integers(0, 20, r.integers(0, 30))), [7] * int(r.integers(0, 9)), [0]]).astype("<u4") for _ in range(300)]
    blob, n = pack([*range(299), None], [d.tobytes() for d in docs])
    s = Shard(blob)
    assert n == sum(map(len, docs)) and len(s.seq) < n / 2 and s.doc_ids[-1] is None
    for i, d in enumerate(docs):
        assert s.document(i).tolist() == d.tolist()
        a = int(r.integers(0, len(d)))
        b = int(r.integers(a, len(d) + 1))
        if a < b:
            assert s.span(i, a, b).tolist() == d[a:b].tolist()


def test_op4_held_out_accuracy(spark, docs):
    from tidewake.llm.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_language_crf"](spark, sf).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_long_tokens_are_read_to_their_end():
    from tidewake.llm.language_crf import fit, words_in

    model = fit(["the cat sat on the mat with the hat"] * 20 + ["der hund und die katze sind nicht hier"] * 20, ["en"] * 20 + ["de"] * 20)
    model.prepare()
    head, tail = "the-cat-sat-on-the-mat-with-the-hat-the-cat", "-der-hund-und-die-katze-sind-nicht-hier" * 20
    assert model.predict([head, head + tail, (head + tail).replace("-", "")])[0] == ["en", "de", "de"]
    assert "".join(words_in("ab" * 5000)) == "ab" * 5000 and words_in("Short words-stay") == ["short", "words-stay"]


def test_crf_forward_backward_equals_enumeration():
    import itertools

    from tidewake.llm.language_crf import Chains

    r = np.random.default_rng(0)
    e, move = r.standard_normal((6, 3)), r.standard_normal((3, 3))
    c = Chains([np.array([0, 1, 2, 3]), np.array([4]), np.array([5, 0, 1])])
    m, z, expected = c.marginals(e[c.items], move, edges=True)
    total, pairs = 0, np.zeros((3, 3))
    for seq in ([0, 1, 2, 3], [4], [5, 0, 1]):
        p = np.zeros((len(seq), 3))
        for y in itertools.product(range(3), repeat=len(seq)):
            w = math.exp(sum(e[s, k] for s, k in zip(seq, y)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            for i, k in enumerate(y):
                p[i, k] += w
        total += math.log(p[0].sum())
        for y in itertools.product(range(3), repeat=len(seq)):
            w = math.exp(sum(e[s, k] for s, k in zip(seq, y)) + sum(move[a, b] for a, b in zip(y, y[1:]))) / p[0].sum()
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w
        lane = [i for i, n in zip(c.order, c.lengths)].index([[0, 1, 2, 3], [4], [5, 0, 1]].index(seq))
        assert np.allclose(m[c.lane == lane], p / p.sum(1, keepdims=True))
    assert z == pytest.approx(total) and np.allclose(expected, pairs)


def test_op6_base_and_model(spark, texts):
    from tidewake.llm.registry import QUERIES

    words = {d: [*(t or "").encode().lower().split(), b"\n"] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    c = collections.Counter(w for d, x in words.items() if not held[d] for w in x)
    n, v = sum(c.values()), len(c)
    rows = QUERIES["op6_gru_scores"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(x), sum(c[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel=1e-9)
        assert r["score"] < 0
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_gru_learns_from_every_training_row(spark):
    """Word order of the rows behind the first START_DOCS (by hash) counts as well, and groups cover all words."""
    from pyspark.sql import functions as F

    from tidewake.llm.gru_lm import PARTS, HOLD, START_DOCS, Scorer, crc_mod, fit, score_documents, word_counts

    n = 2 * START_DOCS
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    first = {r["doc_id"] for r in ids.filter(crc_mod("doc_id", PARTS) != HOLD).orderBy(F.xxhash64("doc_id"), "doc_id").limit(START_DOCS).collect()}
    line = "one two three four five six seven eight".split()
    make = lambda turned: spark.createDataFrame([(i, " ".join(line[::-1] if turned and i not in first and zlib.crc32(str(i).encode()) % 5 != 1 else line)) for i in range(n)], "doc_id long, text string").repartition(3)
    held = next(i for i in range(n) if zlib.crc32(str(i).encode()) % 5 == 1)
    a, b = (score_documents(make(turned)).filter(F.col("doc_id") == held).first() for turned in (False, True))
    assert a["base_score"] == b["base_score"] and a["score"] > b["score"] + 1e-4
    docs = make(True)
    counts = word_counts(docs).collect()
    total = sum(r["trained"] for r in counts)
    scorer = Scorer([(bytes(r["word"]), r["trained"]) for r in counts], total, len(counts))
    assert fit(docs, scorer, group_words=3000) == total == 9 * sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(n))


def test_gru_gradients_and_normalisation():
    from tidewake.llm.gru_lm import Network

    net = Network(words=10, hidden=4, classes=3, seed=5)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    h = np.random.default_rng(1).standard_normal((1, 4))
    total = sum(math.exp(net.outputs(h, np.array([t]))[0]) for t in range(11))
    assert total == pytest.approx(1, abs=1e-6)
    x, hs = np.array([3, 10, 7]), np.random.default_rng(2).standard_normal((3, 4))
    _, dh, d = net.outputs(hs, x, grads=True)
    for name, at in (("c", (2, 1)), ("cb", (0,)), ("o", (1, 3, 2)), ("ob", (2, 3))):
        w, eps = net.w[name], 1e-5
        w[at] += eps
        up = -net.outputs(hs, x).sum()
        w[at] -= 2 * eps
        down = -net.outputs(hs, x).sum()
        w[at] += eps
        assert d[name][at] == pytest.approx((up - down) / (2 * eps), abs=1e-5)
    e = np.zeros_like(hs)
    e[1, 2] = 1e-5
    assert dh[1, 2] == pytest.approx((-net.outputs(hs + e, x).sum() + net.outputs(hs - e, x).sum()) / 2e-5, abs=1e-5)


def test_gru_windows_do_not_change_the_score():
    from tidewake.llm.gru_lm import Network

    net = Network(words=30, hidden=8, classes=4)
    r = np.random.default_rng(4)
    docs = [r.integers(0, 31, n) for n in (1, 5, 200, 64, 65)]
    a, b = net.log_likelihoods(docs, lanes=2, window=7), net.log_likelihoods(docs, lanes=512, window=1000)
    assert np.allclose(a, b, atol=1e-3)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_of(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    for d, s in sets.items():
        for o, n in collections.Counter(o for x in s for o in by[x] if o > d).items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(d), find(o)))
                parent[b] = a
    return {d: find(d) for d in sets}


def test_op7(spark, texts):
    from tidewake.llm.registry import QUERIES

    sets = {d: shingles(t) for d, t in texts.items()}
    want = components_of(sets)
    rows = QUERIES["op7_setsketch_near"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}


@pytest.mark.parametrize("block", [256, 7])
def test_near_copies_around_the_threshold(spark, monkeypatch, block):
    """Families of copies with edits: similarities on both sides of the threshold, chains, and large groups; in one block and in many."""
    from tidewake.llm import near_copies
    from tidewake.llm.near_copies import near_duplicates

    monkeypatch.setattr(near_copies, "FAMILY_BLOCK", block)
    r, rows, n = random.Random(8), [], 0
    for family in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(120)]
        for _ in range(25):
            w = list(base)
            for _ in range(r.randrange(0, 9)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
            if r.random() < 0.3:
                base = w
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of({d: shingles(t) for d, t in rows})


def test_sketch_estimates_and_merges():
    from tidewake.llm.near_copies import estimate, merged, registers

    r = np.random.default_rng(6)
    for j in (0.2, 0.5, 0.75, 0.95):
        common = int(2000 * j / (1 + j) * 1)
        errors = []
        for _ in range(30):
            x = r.integers(0, 2**63, 2000 - common + common, dtype=np.uint64)
            a, b = x[:1000 + common // 2], x[1000 - (common - common // 2) :]
            inter = len(a) + len(b) - 2000
            errors.append(estimate(registers(a)[None], registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0] - inter / 2000)
            assert (registers(np.union1d(a, b)) == merged(registers(a), registers(b))).all()
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def check_packing(rows, want):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for seq in by.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= 4096
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == want
    return len(by)


def test_op8(spark, texts):
    from tidewake.llm.registry import QUERIES

    t, want, total = tokenizer("word_bpe_49k.json"), collections.Counter(), 0
    for d, x in texts.items():
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[d, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    n = check_packing(QUERIES["op8_genetic_packing"](spark, SMALL).collect(), want)
    assert n <= math.ceil(total / 4096) + 1


def test_packing_of_hard_sizes(spark):
    """Large pieces, several blocks and levels: no worse than best fit decreasing over all, every piece placed once."""
    from tidewake.llm.packing import Packing, pack

    r = random.Random(2)
    rows = [(i, 0, 0, r.choice([r.randint(1300, 2100), r.randint(700, 1400)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    n = check_packing(pack(df, block_items=300).collect(), collections.Counter((a, b, c, d, e) for a, b, c, d, e in rows))
    sizes = [x[3] for x in rows]
    best_fit = len(Packing(sizes, 4096).fit(sorted(range(len(sizes)), key=lambda i: -sizes[i])).bins)
    assert n <= best_fit * 1.01 + 1


def test_packing_ends_with_many_pieces_over_half(spark):
    """More pieces that no other joins than a block holds: levels that do not shrink end the packing."""
    from tidewake.llm.packing import pack

    for rows in ([(i, 0, 0, 3000, i) for i in range(300)], [(i, 0, 0, 2500 if i < 300 else 500, i) for i in range(500)]):
        df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
        assert check_packing(pack(df, block_items=100).collect(), collections.Counter(rows)) <= 303


def plain_tiles(item, doc, least=5):
    """Greedy string tiling by scanning."""
    mi, md, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mi[i + n] and not md[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return out
        i, j, n = best
        mi[i : i + n] = [True] * n
        md[j : j + n] = [True] * n
        out.append(best)


def test_tiling_equals_scanning():
    from tidewake.llm.decontamination import tiles

    r = random.Random(4)
    for _ in range(150):
        item = [r.randrange(4 if r.random() < 0.3 else 40) for _ in range(r.randrange(4, 40))]
        doc = []
        while len(doc) < 50:
            a = r.randrange(len(item))
            doc += item[a : a + r.randrange(1, 14)] + [r.randrange(40) for _ in range(r.randrange(3))]
        got = tiles(np.array(item, np.uint64), np.array(doc, np.uint64))
        assert sum(x[2] for x in got) == sum(x[2] for x in plain_tiles(item, doc)) and all(item[i : i + n] == doc[j : j + n] for i, j, n in got)


def test_op9(spark, texts):
    import re

    from tidewake.llm.registry import QUERIES

    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    norm = lambda t: [w for w in ("".join(filter(str.isalnum, x)) for x in (t or "").lower().split()) if w]
    want = {}
    for d, t in texts.items():
        doc = norm(t)
        seeds = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
        for i, b in items.items():
            w = norm(b)
            if len(w) >= 5 and any(tuple(w[k : k + 5]) in seeds for k in range(len(w) - 4)):
                n = sum(x[2] for x in plain_tiles(w, doc))
                if n >= 0.6 * len(w):
                    want[d, i] = n
    assert want and {(r["doc_id"], r["item_id"]): r["words"] for r in QUERIES["op9_string_tiling"](spark, SMALL).collect()} == want
    assert re  # the planted passages are whole


def test_decontamination_catches_reordered_passages_and_many_blocks(spark):
    from tidewake.llm import decontamination as D

    item = [f"tok{i}" for i in range(30)]
    moved = item[20:] + ["other"] * 9 + item[:20]
    b = D.Benchmark([1, 2], [" ".join(item), "too short"])
    assert [x[:3] for x in b.leaks("Well, " + " ".join(moved).upper() + "!")] == [(1, 1.0, 30)]
    assert b.leaks(" ".join(item[:15])) == [] and b.leaks(None) == [] and b.leaks("") == []
    bench = spark.createDataFrame([(i, " ".join(f"b{i}w{k}" for k in range(12))) for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"b{i}w{k}" for k in range(12)) + " end") for i in range(0, 40, 3)], "doc_id long, text string")
    blocks = D.benchmark_blocks(bench, block_words=100)
    hits = [x for index in blocks for r in docs.collect() for x in [(r["doc_id"], y[0]) for y in index.value.leaks(r["text"])]]
    assert sorted(hits) == [(i, i) for i in range(0, 40, 3)]


def test_op10(spark):
    from tidewake.llm.registry import QUERIES

    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    n = np.sqrt((x * x).sum(1))
    want = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q] / (n * n[q])
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-round(s[i], 12), ids[i]))[:5]
        want[int(ids[q])] = [int(ids[i]) for i in order]
    got = collections.defaultdict(dict)
    for r in QUERIES["op10_block_neighbours"](spark, SMALL).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == want


def test_neighbours_in_blocks_with_ties_and_bad_vectors(spark):
    from tidewake.llm.neighbours import block_matrix_join

    r = np.random.default_rng(9)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(100 + i, r.standard_normal(3).tolist()) for i in range(80)]
    rows += [(300, None), (301, []), (302, [0.0, 0.0, 0.0]), (303, [1.0, None, 2.0]), (304, [float("nan"), 1.0, 1.0]), (305, [1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (3, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = block_matrix_join(df, df, block=16)
    got = collections.defaultdict(list)
    for x in out.orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[3]] == [0, 1, 2, 4, 5]
    assert 305 not in got and 300 not in got and len(got) == 140
    good = {i: np.array(np.float32(v), np.float64) for i, v in rows if i is not None and i < 300}
    for q in (104, 150):
        s = sorted(((-float(good[q] @ v / math.sqrt((good[q] @ good[q]) * (v @ v))), i) for i, v in good.items() if i != q))[:5]
        assert [x for x, _ in got[q]] == [i for _, i in s] or np.allclose([x for _, x in got[q]], [-a for a, _ in s], atol=1e-12)


def test_neighbours_among_repeated_rows_of_equal_vectors(spark):
    from tidewake.llm.neighbours import block_matrix_join

    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1, 8) for _ in range(2)] + [(0, [1.0, 2.0, 3.1]), (20, [-1.0, 2.0, 0.5]), (21, [3.0, -2.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = block_matrix_join(df, df.filter("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]
