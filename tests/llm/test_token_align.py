"""Token groups of two tokenizers against byte offsets."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import token_align
from graphloom.llm.token_align import Transducer

BYTES, PIECES, RANKS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")


def brute(texts):
    """By offsets: the ends that both sides have, and what lies between them."""
    a_model, b_model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    a_side, b_side = token_align.ByteSide(BYTES, None, None), token_align.PieceSide(PIECES)
    found, links = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = a_model.encode(" " + (text or ""), add_special_tokens=False).ids, b_model.encode(text or "")
        if not text or b"".join(a_side.bytes[i] for i in a) != raw or b"".join(b_side.bytes[i] for i in b) != raw:
            found.append(None)
            continue
        ends = [[], []]
        for out, ids, size in ((ends[0], a, a_side.bytes), (ends[1], b, b_side.bytes)):
            for i in ids:
                out.append((out[-1] if out else 0) + len(size[i]))
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, own, before = [], [], 0
        for end in shared:
            sides = [[i for i, e in zip(ids, side, strict=True) if before < e <= end] for ids, side in zip((a, b), ends, strict=True)]
            groups.append("|".join(",".join(map(str, s)) for s in sides))
            own.append((sides[0][-1], sides[1][-1]))
            before = end
        links.update(own)
        found.append((len(a), len(b), groups, own))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return [
        (0, 0, 0, 0, "", 0, 0) if f is None else (f[0], f[1], len(f[2]), len(f[3]), ";".join(f[2]), sum(links[x] == most[x[1]] for x in f[3]), sum(links[x] for x in f[3])) for f in found
    ]


def run(spark, texts, ranks):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = token_align.corpus_alignment(docs, BYTES, PIECES, ranks, P.PATTERN if ranks else None).collect()
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in sorted(got, key=lambda r: r.doc_id)]


def test_equals_offsets(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    hard = [None, "", " ", "  two  spaces ", "\t\n", "é漢🎉", "<|endoftext|> and </s><unk>", "ﬁ ligature", "a\u0000b", "▁ mark", "don't 12345 x", "x" * 5000, "words " * 20_000, "é", "  　"]
    rng = random.Random(3)
    mixed = ["".join(rng.choice("ab  \n'é漢🎉12.<|>▁") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts = docs + hard + mixed + hard
    assert run(spark, texts, RANKS) == brute(texts) == run(spark, texts, None)


def test_clashing_and_empty(spark):
    docs = spark.createDataFrame([(1, "a text", 5, "g", "b")], "doc_id long, text string, n_a int, groups string, a_bytes string")
    got = token_align.corpus_alignment(docs, BYTES, PIECES)
    assert got.columns[:3] == ["doc_id", "text", "a_bytes"] and got.first().n_a == 2 and got.first().a_bytes == "b"
    assert token_align.corpus_alignment(docs.where("false"), BYTES, PIECES).count() == 0
    nothing = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert {(r.n_groups, r.n_best, r.count_sum) for r in token_align.corpus_alignment(nothing, BYTES, PIECES).collect()} == {(0, 0, 0)}


def test_transducer_states():
    machine = Transducer([b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abcd", b"d"])
    assert machine.closings([0, 1, 3], [0, 1, 3]) == ([2, 3], [2, 3])
    assert machine.closings([0, 1, 3], [2]) == ([3], [1])
    assert machine.closings([2, 3], [0, 1, 3]) == ([1, 2], [2, 3])
    before = len(machine.states)
    machine.closings([0, 1, 3] * 100, [0, 1, 3] * 100)
    assert len(machine.states) == before
    with pytest.raises(ValueError, match="differ"):
        machine.closings([0], [3])


def test_digest_of_groups(spark):
    text = "Some words of a text"
    got = run(spark, [text], RANKS)[0]
    assert len(hashlib.sha256(got[4].encode()).hexdigest()) == 64 and got[4].count(";") == got[2] - 1 and got[4].count("|") == got[2]
