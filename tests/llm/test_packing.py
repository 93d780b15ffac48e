"""Packing: exact round trip, gapless windows, no padding but at powers of two, closest fill."""

import itertools
import random

import numpy as np
from tokenizers import Tokenizer

from tessella.llm.packing import Packer, closest_fill, pack, pack_digest
from tessella.llm.tokens import byte_encoder, in_groups, vocabulary, word_encoder


def test_closest_fill_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 30), rng.randint(1, 5))}
        capacity = rng.randint(0, 60)
        total, chosen = closest_fill(sorted(counts), counts, capacity)
        sums = {sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*(range(c + 1) for c in counts.values()))}
        assert total == max(s for s in sums if s <= capacity)
        assert total == sum(n * k for n, k in chosen.items()) and all(k <= counts[n] for n, k in chosen.items())


def check_windows(pieces, capacity):
    windows, documents = {}, {}
    for row, start, ids, window, offset in pieces:
        windows.setdefault(window, []).append((offset, len(ids) // 4))
        documents.setdefault(row, []).append((start, ids))
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    return {row: b"".join(ids for _, ids in sorted(parts)) for row, parts in documents.items()}


def test_every_window_is_full():
    rng = random.Random(1)
    for trial in range(20):
        capacity = rng.choice([8, 64, 4096])
        packer, docs = Packer(capacity, 0), {}
        for _ in range(3):
            block = []
            for _ in range(rng.choice([0, 1, 5, 300])):
                n = capacity * 3 // 4 if trial % 3 == 0 else rng.randint(1, capacity - 1)
                docs[len(docs)] = ids = rng.randbytes(4 * n)
                block.append((len(docs) - 1, 0, ids))
            packer.block(block)
            assert sum(len(p[2]) // 4 for p in packer.left) < capacity
        packer.finish()
        assert check_windows(packer.out, capacity) == docs


ODD = ["", "  a  b \n\n c", "Ünï é it's don't <|endoftext|>", "a　b\x1cc ﬁ ½", "日本語 テスト", "a ́b ΑΣ", "1234 '' 's", "a\x00b \x85 \xa0x"]


def test_memo_gives_the_tokenizer_s_ids():
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    path = vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(2)
    each = "".join(f"wo{chr(c)}rd {chr(c)}a b{chr(c)} 1{chr(c)}'s " for c in range(0x20, 0x300))
    texts = ODD + [each, *(f"ab{chr(c)}cd {chr(c)}" for c in range(0x300)), "a<|startoftext|>b <|ENDOFTEXT|>"] + ["".join(rng.choice("aBé'st re\n\t.,1½\xa0 Σ") for _ in range(40)) for _ in range(300)]
    for text, ids in zip(texts, in_groups(word_encoder(path), texts, chars=50)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    path = vocabulary("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, ids in zip(texts, in_groups(byte_encoder(path), texts, chars=50)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode_ordinary(text)
        assert whole.decode(np.frombuffer(ids, "<u4").tolist()) == text


def test_pack_rows(spark):
    texts = [*ODD, None, "word " * 9000, *["same text"] * 40]
    df = spark.createDataFrame([(i if i else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    rows = pack(df, block_docs=7).collect()
    docs = check_windows([((r.doc_id, r.doc_tokens), r.start, r.ids, r.sequence_id, r.offset) for r in rows], 4096)
    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for i, t in enumerate(texts):
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(docs[(i or None, len(want))], "<u4").tolist() == want
    digest = pack_digest(df, block_docs=7)
    assert digest.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pack(df.limit(0)).count() == 0
