"""Token alignment against a plain double loop over byte ranges, with piece sizes and head tables that force every way."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from asofkit.llm import alignment as al


def plain(texts):
    """The contract, token pair by token pair."""
    enc_a, enc_b, a_bytes, b_bytes = al.load_tokenizers(al.TOKENIZERS, al.A_FILE, al.B_FILE)
    found = []
    for text in texts:
        want = (" " + (text or "")).encode()
        a = enc_a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = enc_b.encode(text) if text else []
        if not text or b"".join(a_bytes[t] for t in a) != want or b"".join(b_bytes[t] for t in b) != want:
            found.append((0, 0, [], []))
            continue
        ranges = lambda ids, table: [(sum(len(table[t]) for t in ids[:k]), sum(len(table[t]) for t in ids[: k + 1])) for k in range(len(ids))]
        ra, rb = ranges(a, a_bytes), ranges(b, b_bytes)
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if ra[i][0] < rb[j][1] and rb[j][0] < ra[i][1]]
        common = sorted({e for _, e in ra} & {e for _, e in rb})
        groups = [(",".join(str(a[i]) for i in range(len(a)) if lo <= ra[i][0] < hi), ",".join(str(b[j]) for j in range(len(b)) if lo <= rb[j][0] < hi)) for lo, hi in zip([0, *common], common)]
        found.append((len(a), len(b), groups, links))
    held = Counter(p for *_, links in found for p in set(links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [
        (na, nb, len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(f"{x}|{y}" for x, y in groups).encode()).hexdigest() if groups else "")
        for na, nb, groups, links in found
    ]


TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "The quick brown fox, indeed.", None, "", " ", "  two  spaces\n\tand tabs\r\n", "naïve façade — “quoted” 東京 🙂 é", "<|endoftext|> <s> </s> <0x41> <unk>",
    "a▁b", "ﬁ ligature Ａ wide  ", "x" * 700, "1234567890 " * 40, "The quick brown fox jumps over the lazy dog.", "\x00\x01\x7f", "antidisestablishmentarianism unbelievably " * 30,
]


@pytest.mark.parametrize("steps, head_pairs", [(256, 1 << 19), (1, 0), (7, 40)])
def test_alignment_equals_a_plain_double_loop(spark, steps, head_pairs):
    rows = [(k if k % 5 else None, t, "x", 3) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, part string, pairs int").repartition(3)
    got = al.pair_scores(docs, steps=steps, head_pairs=head_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(r[0], *p) for r, p in zip(rows, plain(TEXTS))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) >= 9 and any(w[1] == 0 and t for w, t in zip(want, TEXTS))


def test_pieces_of_any_size_give_the_same_merge():
    rng = np.random.default_rng(5)
    for _ in range(60):
        total = int(rng.integers(1, 200))
        cut = lambda p: np.unique(np.append(np.flatnonzero(rng.random(total) < p), total))
        a, b = (x[x > 0] for x in (cut(rng.random()), cut(rng.random())))
        whole = al.merge_pieces(a, b, len(a) + len(b))
        for steps in (1, 2, 3, 17):
            assert all(np.array_equal(x, y) for x, y in zip(whole, al.merge_pieces(a, b, steps)))
        assert len(whole[0]) == len(a) + len(b) - len(np.intersect1d(a, b))


def test_counts_are_given_out_in_portions(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} and word{k % 3}") for k in range(50)], "doc_id int, text string")
    aligned = al.align_documents(docs)
    whole, small = ({tuple(r) for r in al.pair_counts(aligned, most_held=n).collect()} for n in (1 << 20, 3))
    assert whole == small and len(whole) > 5


def test_empty_table(spark):
    assert al.pair_scores(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
