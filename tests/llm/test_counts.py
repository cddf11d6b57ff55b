"""Token counts, phrases and whitening against brute force, on small tables with awkward rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

from lectern.llm import collocations, tokencount, whitening
from lectern.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "\n", " \n ", "▁", "▁▁a ▁", "<s>a</s> <unk><0x0A>", "Hello  world\tof things.\nNext line", "ﬁ　中文字ゼ \U0001f600 \x85\x00a", "a" * 100_000, "word " * 30_000, " " * 5000 + "x", "Hello  world\tof things.\nNext line"]
SCHEMA = "doc_id long, text string, lang string, n_tokens string, f string, ids string, id string"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, "clash", "clash", "clash", "clash") for k, t, lang in rows], SCHEMA).repartition(3)


def test_token_counts_as_the_library(spark):
    found = {r.doc_id: r for r in tokencount.token_counts(docs(spark, [(k, t, None) for k, t in enumerate(TEXTS)]), MODEL).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k, text in enumerate(TEXTS):
        n = len(library.encode(text or ""))
        assert (found[k].n_bytes, found[k].n_tokens, found[k].over_limit) == (len((text or "").encode()), n, n > 4096)


def test_token_counts_repeated_and_missing_ids(spark):
    rows = [(2**53 + 1, "one two", None), (2**53 + 1, "one two", None), (None, "three", None), (None, None, None)]
    found = tokencount.token_counts(docs(spark, rows), MODEL).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 0), (0, 1), (2**53 + 1, 2), (2**53 + 1, 2)]
    assert tokencount.token_counts(docs(spark, []), MODEL).count() == 0


def test_pre_tokens_on_random_strings():
    with open(MODEL, "rb") as f:
        model = f.read()
    single = tokencount.prove(model)
    counter = tokencount.Counter(model, single)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    draw = random.Random(5)
    signs = [chr(c) for c in range(128)] + list("éß▁　ﬁ中ゼ\U0001f600\x85\xa0") + ["the", "tion", " of", "  ", "<s>", "ing", "▁▁"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 50))) for _ in range(5000)]
    assert [n for n, _ in counter.counts(texts)] == [len(x) for x in library.encode(texts)]
    assert all(len(library.encode(p[1:])) == 1 for p in single if p.startswith("▁") and p.strip("▁") and not p.startswith("▁▁"))


# -- phrases


def brute_phrases(rows, least, kept=2000, longest=5):
    import re

    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = {q[i : i + k] for q, a in often.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * a >= 100 * counts[q[i : i + k]]}
        ranked = []
        for p, a in often.items():
            if p not in covered:
                score, cut = min((1000 * a * n[lang] // (counts[p[:j]] * counts[p[j:]]), j) for j in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, k, p.decode(), -a, x, y, n[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(ranked)[:kept], 1)]
    return sorted(out)


def phrase_rows(seed=3, n=120):
    draw = random.Random(seed)
    spoken = ["New", "york", "CITY", "of", "the", "a", "é", "字", "\x00", "x y", "stock", "exchange"]
    rows = [(" ".join(draw.choices(spoken, weights=range(1, 13), k=draw.randint(0, 60))).replace("of the", draw.choice(["of the", "of, the", "of \t the", "of\nthe"])), draw.choice(["en", "EN", "a b", None])) for _ in range(n)]
    return [*rows, ("the hot line again and again. " * 900, "en"), ("the hot line again and again", "en"), (None, "en"), ("", None), ("w" * 100_000, "en"), ("only here", "a")]


@pytest.mark.parametrize(("least", "kept"), [(5, 2000), (12, 7)])
def test_phrases(spark, least, kept):
    rows = phrase_rows()
    made = collocations.top_collocations(docs(spark, [(7, t, lang) for t, lang in rows]), kept, least=least)
    assert sorted(tuple(r) for r in made.collect()) == brute_phrases(rows, least, kept)
    assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_no_phrases(spark):
    assert collocations.top_collocations(docs(spark, [])).count() == 0
    assert collocations.top_collocations(docs(spark, [(1, "one two three", "en"), (2, None, None)])).count() == 0


def test_trie_bursts_and_spills():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 400, (100_000, 3)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ids[::3, 0] = ids[0, 0]  # one word starts a third of all phrases
    ids[::4, :2] = ids[0, :2]
    trie, total, runs, burst = collocations.HatTrie(3, burst=3000, limit=20_000), Counter(), 0, False
    for at in range(0, len(ids), 5000):
        for found, counts in trie.add(ids[at : at + 5000]):
            assert [tuple(x) for x in found.tolist()] == sorted(set(map(tuple, found.tolist())))
            runs += 1
            total.update(dict(zip(map(tuple, found.tolist()), counts.tolist(), strict=True)))
        burst |= any(isinstance(c, collocations.Node) for c in trie.root.children)
        assert trie.root.rows() <= 20_000
    assert runs and burst
    for found, counts in trie.spill():
        total.update(dict(zip(map(tuple, found.tolist()), counts.tolist(), strict=True)))
    assert total == Counter(map(tuple, ids.tolist())) and not trie.root.rows()


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "phrase_keys", lambda ids: ids[:, 0] & np.uint64(1))
    ids = np.array([[1, 2], [3, 4], [1, 2], [2, 2]], dtype=np.uint64)
    rows, counts = collocations.merged(ids, np.array([1, 1, 5, 1]))
    assert dict(zip(map(tuple, rows.tolist()), counts.tolist(), strict=True)) == {(1, 2): 6, (3, 4): 1, (2, 2): 1}


# -- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, "clash", "clash") for k, v in rows], "vec_id long, embedding array<float>, x string, n string").repartition(3)


def brute_whitening(rows, k=4):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    values, turn = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return [i for i, _ in kept], n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ turn[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(rng.normal(size=(300, 12)) * np.linspace(2, 0.2, 12))]
    rows += [(900 + k, rows[0][1]) for k in range(150)]  # a third of all rows is one vector
    rows += [(None, rows[1][1]), (1, None), (2, []), (3, [1.0] * 5), (4, [None] + [1.0] * 11), (5, [float("nan")] * 12), (6, [float("inf")] * 12), (7, [1e30] * 12)]
    made = whitening.whiten(vectors(spark, rows)).collect()
    ids, n, deviation, white, share = brute_whitening(rows[:450] + [rows[450]])
    assert len(made) == 4 * len(ids) and {r.n for r in made} == {n}
    found = {(r.vec_id, r.component): r for r in made}
    signs = [math.copysign(1, found[0, c + 1].whitened * white[0, c]) for c in range(4)]
    for at, key in enumerate(ids):
        for c in range(4):
            r = found[key, c + 1]
            assert r.deviation == deviation[at] and abs(r.whitened - signs[c] * white[at, c]) < 1e-9 and abs(r.explained - share[c]) < 1e-12
    assert max(r.identity_error for r in made) < 1e-10


def test_whitening_of_next_to_nothing(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    flat = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened) for r in flat] == [(1, 0, 0.0)] * 4
    line = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k]) for k in range(5)])).collect()
    assert {r.component for r in line} == {1, 2} and max(abs(r.explained - (r.component == 1)) for r in line) < 1e-12


@pytest.mark.parametrize("values", [np.linspace(1, 64, 64), np.array([10.0] * 8 + [10 + 1e-9] * 4 + [3.0] * 20 + [0.5] * 3), np.array([5.0, 4, 3] + [0.0] * 30), 2.0 ** -np.arange(64), 10 + 1e-10 * np.arange(40), np.array([3.0])])
def test_refined_eigenvectors(values):
    turn, _ = np.linalg.qr(np.random.default_rng(8).normal(size=(len(values), len(values))))
    a = (turn * values) @ turn.T
    a = (a + a.T) / 2
    found, x = whitening.refined(a)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 2e-15
    assert np.abs(a @ x - x * found).max() < 3e-15 * values.max() and np.abs(found - np.sort(values)[::-1]).max() < 3e-15 * values.max()


def test_exact_deviations():
    x, sums = np.array([[3_000_000, -5], [1, 2]]), np.array([7, 1 << 40])
    assert whitening.deviations(x, 1000, sums) == [(3_000_000_000 - 7) ** 2 + (5000 + (1 << 40)) ** 2 if (3_000_000_000 - 7) ** 2 + (5000 + (1 << 40)) ** 2 < 1 << 63 else None, (1000 - 7) ** 2 + (2000 - (1 << 40)) ** 2 if (1000 - 7) ** 2 + (2000 - (1 << 40)) ** 2 < 1 << 63 else None]


# -- ids beside nulls


def test_great_ids_beside_null_ids(spark):
    """Longs beyond 2 ** 53 keep their last digits where another row has no id."""
    from lectern.llm import ngramjoin, packing

    far = 2**53
    text = "one two three four five six seven"
    rows = [(far + 1, text), (far, "quite another text than the first one here"), (far + 3, text), (None, text), (None, None), (far + 3, text), (far + 5, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    joined = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngramjoin.join_components(table).collect())
    assert joined == [(0, 0, 0), (0, 3, far + 1), (far, 4, far), (far + 1, 3, far + 1), (far + 3, 3, far + 1), (far + 3, 3, far + 1), (far + 5, 0, far + 5)]
    packed = packing.pack(table, vocabulary("byte_bpe_50k.json")).collect()
    assert sorted(r.doc_id or 0 for r in packed) == sorted(r[0] or 0 for r in rows)


def test_many_empty_texts(spark):
    from lectern.llm import ngramjoin

    table = spark.range(100_000).selectExpr("id as doc_id", "if(id % 2 = 0, '', null) as text")
    assert ngramjoin.join_components(table).where("n_shingles = 0 and component_id = doc_id").count() == 100_000
