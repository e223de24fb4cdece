"""The Jaccard join on groups of near copies in small blocks, word hashes, and the whole pipeline, against brute force."""

import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from asofkit.llm import jaccard, toxicity
from asofkit.llm.mixing import take_mixture
from asofkit.llm.text_kernel import scan_words
from tests.llm.test_corpus_operators import SCHEMA, components, words


def near_copies(n, changes, seed):
    """Copies of one text with some words changed, so that some pairs link, some only through others, and some not at all."""
    rng = np.random.default_rng(seed)
    base = words(120, seed).split()
    out = []
    for k in range(n):
        text = list(base)
        for at in rng.integers(0, len(text), int(rng.integers(0, changes))):
            text[at] = f"x{k}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block_bytes", [400, 1 << 19])
def test_tiles_of_many_members_in_any_block_size(spark, monkeypatch, block_bytes):
    texts = near_copies(110, 9, 1) + [t[:150] for t in near_copies(40, 5, 2)] + [words(k, k) for k in range(1, 30)] + ["a b c d e f " + words(60, k) for k in range(40)]
    rows = [(i, t, "en", "s", 0, "x", 1) for i, t in enumerate(texts)]
    monkeypatch.setattr(jaccard, "_late_links", functools.partial(jaccard._late_links, block_bytes=block_bytes))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == components(rows, 5, 0.8)


def test_a_block_meets_itself_in_any_order():
    rng = np.random.default_rng(5)
    cls = rng.permutation(30).astype(np.int64)
    tiles = [np.unique(rng.integers(0, 25, 4)) for _ in cls]
    label = rng.integers(0, 6, len(cls))
    want = {(min(cls[a], cls[b]), max(cls[a], cls[b])) for a in range(30) for b in range(30) if label[a] != label[b] and set(tiles[a]) & set(tiles[b])}
    for _ in range(20):
        order = rng.permutation(30)  # the other copy of the block stands in another order
        i, j = jaccard.meeting_pairs(tiles, [tiles[k] for k in order], label, label[order], cls, cls[order], True)
        got = [(cls[a], cls[order][b]) for a, b in zip(i, j)]
        assert len(got) == len(set(got)) and set(got) == want


def test_linked_sets_share_a_tile_that_neither_can_spare():
    rng, threshold = np.random.default_rng(3), jaccard.Fraction("0.8")
    for n in (1, 2, 4, 7, 12, 25, 60, 150, 400):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate((a[: len(a) - int(rng.integers(0, len(a) // 5 + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64))))
            common = len(np.intersect1d(a, b))
            if common < 0.8 * (len(a) + len(b) - common):
                continue
            row, tile, mark = jaccard.tiles_of(np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b)), np.array([len(a), len(b)]), threshold)
            frequency = {t: int(rng.integers(1, 1000)) for t in sorted(set(tile.tolist()))}
            kept = []
            for r in (0, 1):
                mine = set()
                for step in (0, 128):
                    own = [(frequency[t], t) for t, m in zip(tile[row == r].tolist(), mark[row == r].tolist()) if m & 128 == step]
                    spare = next((m & 127 for m in mark[row == r].tolist() if m & 128 == step), 0)
                    mine |= set(sorted(own)[: len(own) - spare])
                kept.append(mine)
            assert kept[0] & kept[1]


def test_word_hashes_of_thue_morse_words_differ():
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    got = scan_words(pa.array([f"{word} {other}", "abcdefgh abcdefghi abcdefg", None])).hash
    assert len(set(got.tolist())) == 5
    assert scan_words(pa.array([word])).hash[0] == got[0]


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    texts = [words(80, k) + "." for k in range(60)] + near_copies(12, 4, 77)
    for k in range(0, 60, 6):
        texts[k] += " You are a vile hateful wretch."
    item = words(15, 500)
    texts[3] += " " + item
    texts[5] = None
    docs = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0, "x", 1) for i, t in enumerate(texts)]
    labels = [(i, int(rng.integers(0, 2)), int(i < 60 and i % 6 == 0)) for i in range(len(texts))]
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", [(1, item), (2, None)], "item_id bigint, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # stage by stage in plain Python
    encoded = [toxicity.encode(t) for t in texts]
    model = toxicity.fit_noisy_or(encoded, [y for _, _, y in labels])
    kept = [r for r in docs if model.document_score(r[1]) < toxicity.THRESHOLD]
    assert not {i for i, _, y in labels if y} & {r[0] for r in kept}
    least = components(kept, 5, 0.8)
    kept = [r for r in kept if least[r[0]][1] == r[0]]
    window = lambda t: {tuple(w[k : k + 10]) for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))] for k in range(max(len(w) - 9, 1))} - {()}
    kept = [r for r in kept if not window(r[1]) & window(item)]
    assert 3 not in {r[0] for r in kept} and 5 in {r[0] for r in kept}
    mixed = Counter(r["doc_id"] for r in take_mixture(spark.createDataFrame(kept, SCHEMA)).collect())
    assert Counter(r["doc_id"] for r in got) == mixed
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
