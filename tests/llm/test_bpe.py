import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("word_bpe_49k.json"))

TEXTS = [
    None, "", "   ", "Hello, World!", "it's they'll we've I'M", "naïve Évian ÇA ß ñandú", "é ́x àb", "日本語 text ٣٤ ½ ①",
    "a<|endoftext|>b <|startoftext|>", "\x00\x1c\x1f x\x0by z w\u0085v", "ΟΔΟΣ ὈΔΥΣΣΕΎΣ Σ", "İstanbul ﬁne ＡＢＣ", "😀👍🏽 ok", "a" * 5000, "word." * 900,
    "".join(random.Random(5).choice("abcdefgh") for _ in range(9000)), "é" * 3000 + "!" * 3000, "12345 3.14 x_y --- ...",
]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_digest_matches_library(spark):
    from rastrel.llm import bpe

    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "x", "c"), (3, "Hello, World!", "c")], "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digest(docs, PATH).drop("n_joins").collect()), key=str)
    t = library()
    want = []
    for i, x in [*enumerate(TEXTS), (None, "x"), (3, "Hello, World!")]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_tree_concatenation_random():
    from rastrel.llm import bpe

    t, coder, rng = library(), bpe.WordEncoder(PATH), random.Random(1)
    for alphabet in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "the"):
        for n in (2049, 4096, 7001):
            x = "".join(rng.choice(alphabet) for _ in range(n))
            assert coder._long(x) == t.encode(x, add_special_tokens=False).ids


def test_joins_agree_with_the_library():
    import pyarrow as pa

    from rastrel.llm import bpe

    t, rng = library(), random.Random(2)
    words = ["the", "it's", "Été", "x" * 300, "3.14", "<|endoftext|>", "don't!!", "日本語", "ﬁ", "ab<|startoftext|>c", "e\u0301", "\u0301", "Σ", "a" * 700]
    seps = [" ", "  ", "\n", "\t ", "\u00a0", "\x1c", ""]
    for leaf, around in ((1, 1), (3, 2), (7, 1), (50, 2)):
        coder = bpe.WordEncoder(PATH)
        for name, value in (("LEAF", leaf), ("AROUND", around), ("LONG", 600), ("WORD_LEAF", 60)):
            setattr(bpe, name, value)
        try:
            texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 12 if leaf > 1 else 4))) for _ in range(40)]
            ids, at, joins = coder.encode_counted(pa.array([None, *texts], pa.string()))
        finally:
            for name, value in (("LEAF", 2048), ("AROUND", 2), ("LONG", 2048), ("WORD_LEAF", 512)):
                setattr(bpe, name, value)
        assert [ids[a:b].tolist() for a, b in zip(at[1:-1], at[2:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert joins.tolist() == [0, *(max(0, -(-len(x) // leaf) - 1) for x in texts)]


def test_files_with_tokens_across_white_space():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from rastrel.llm import bpe

    path = str(P.path("byte_bpe_50k.json"))
    texts = ["Hello  there,\n\n world", "x" * 5000 + " y", "", "  a"]
    ids, at, _ = bpe.WordEncoder(path).encode_counted(pa.array([*texts, None]))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in want] + [[]]


def test_encode_decode_columns(spark):
    from rastrel.llm import bpe

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:8])], "doc_id long, text string")
    t = library()
    for r in bpe.decode_ids(bpe.encode_documents(docs, PATH), PATH).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == t.decode(ids, skip_special_tokens=False)


def test_empty_table(spark):
    from rastrel.llm import bpe

    assert bpe.digest(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
