"""Token counts, the BPE tree and packing against the libraries themselves."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from chargelake.llm.bpe_tree import TreeEncoder, decode_bpe, decode_tree, digest_bpe, encode_bpe, token_table
from chargelake.llm.bytebpe import prove_single_tokens, ranks_of_tiktoken, tiktoken_split
from chargelake.llm.packing import best_windows, pack_documents
from chargelake.llm.token_counts import count_tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGE = [
    None, "", " ", "\n", "a", "  a  b ", "don't we'll I'm", "x" * 3000, "<|endoftext|>", "a<|endoftext|> b<|endoftext|>",
    "日本語テキスト" * 50, "naïve café́", "tab\tand\r\nlines\n\n\n end ", "՘꟎ odd letters", "😀😀 1234567 ² ½", "word " * 5000, "\x1c \x1d",
]


def library():
    return Tokenizer.from_file(JSON)


def multi():
    return tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of_tiktoken(MULTI), special_tokens={})


def edge_docs(docs_of):
    rows = list(enumerate(EDGE)) + [(3, EDGE[3]), (None, "a row without id"), (None, None)]
    return docs_of(rows)


def test_proved_strings_are_single():
    singles, t = prove_single_tokens(JSON), library()
    assert len(singles) > 49_000
    for s in random.Random(0).sample(sorted(singles), 200):
        assert len(t.encode(s, add_special_tokens=False).ids) == 1


def test_counts_equal_library(spark, table, docs_of):
    t = library()
    for docs in (table("documents"), edge_docs(docs_of)):
        texts = [r["text"] or "" for r in docs.collect()]
        want = sorted((len(s.encode()), len(e.ids)) for s, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)))
        got = count_tokens(docs, JSON).collect()
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_clashing_columns_and_empty_table(spark, docs_of):
    docs = edge_docs(docs_of).selectExpr("*", "'x' n_tokens", "'y' token_ids", "1 as `start`")
    assert {"in_n_tokens", "n_tokens"} <= set(count_tokens(docs, JSON).columns)
    assert {"in_token_ids", "token_ids"} <= set(encode_bpe(docs, MULTI).columns)
    assert pack_documents(docs, JSON).count() >= docs.count()
    none = docs.filter("false")
    assert count_tokens(none, JSON).count() == encode_bpe(none, MULTI).count() == pack_documents(none, JSON).count() == digest_bpe(none, MULTI).count() == 0


def test_tree_equals_library():
    e, trees, rng = multi(), [TreeEncoder(MULTI, n) for n in (1, 2, 3, 7, 30)], random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'", "s", "l", "r", "e", "1", "²", "é", "!", " ", "日本", "don't", "\x1c", "́", "😀", "\t", "\r\n", "the "]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        ids = rng.choice(trees).ids(s)
        assert ids == e.encode_ordinary(s)
        assert decode_tree(ids, token_table(MULTI), 3) == s.encode()


def test_long_pre_tokens_and_unlike_characters():
    """Runs without a space at the production leaf, and characters that the pattern engines class differently."""
    e, tree, rng = multi(), TreeEncoder(MULTI), random.Random(2)
    for letters in ("abcdefghij", "日本語学校東京都市", "аеиоуклмн", "1234567890", "!?*#"):
        for _ in range(20):
            s = "".join(rng.choice(letters) for _ in range(rng.randint(60, 3000)))
            assert tree.ids(s) == e.encode_ordinary(s)
    assert tree.self_encoded
    unlike = sorted(tiktoken_split()[0])
    assert unlike
    for _ in range(500):
        s = "".join(rng.choice(unlike) if rng.random() < 0.3 else rng.choice(["a", "é", " ", "1", "!", "\n", "  ", "'s"]) for _ in range(rng.randint(0, 300)))
        assert tree.ids(s) == e.encode_ordinary(s)


def test_tokenizer_without_special_tokens(tmp_path, spark, docs_of):
    model = json.load(open(JSON))
    model["added_tokens"] = []
    path = f"{tmp_path}/plain.json"
    json.dump(model, open(path, "w"))
    t = Tokenizer.from_file(path)
    got = count_tokens(edge_docs(docs_of), path, keep=["text"]).collect()
    assert all(r["n_tokens"] == len(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in got)


def test_codec_query(spark, table, docs_of):
    e = multi()
    for docs in (table("documents"), edge_docs(docs_of)):
        want = []
        for r in docs.collect():
            ids = e.encode_ordinary(r["text"] or "")
            sha = lambda b: hashlib.sha256(b).hexdigest()
            want.append((str(r["doc_id"]), len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode())))
        assert sorted((str(r[0]), *r[1:]) for r in digest_bpe(docs, MULTI).collect()) == sorted(want)
        back = decode_bpe(encode_bpe(docs, MULTI), MULTI)
        assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect())


def check_pieces(pieces, docs, t, capacity=2048):
    """Every document's ids once, in pieces that fill gapless sequences; the length of each sequence.

    Rows with the same id or text are told apart by their pieces: each document is put together from pieces of its id.
    """
    want = Counter((str(r["doc_id"]), tuple(t.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in docs.collect())
    sequences, of = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for p in pieces:
        assert zlib.crc32(np.array(p["ids"], dtype="<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"] > 0
        sequences[p["sequence_id"]].append(p)
        of[str(p["doc_id"])][p["start"]].append(p)
    for rows in sequences.values():
        at = 0
        for p in sorted(rows, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    for (i, ids), n in want.items():
        for _ in range(n):
            at = 0
            while at < len(ids):
                found = next(p for p in of[i][at] if p["doc_tokens"] == len(ids) and tuple(p["ids"]) == ids[at : at + p["length"]])
                of[i][at].remove(found)
                at += found["length"]
    assert not any(rest for starts in of.values() for rest in starts.values())
    return [sum(p["length"] for p in rows) for rows in sequences.values()]


def padding_share(lengths):
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths) / sum(lengths)


def test_packing_keeps_every_id_once(spark, table, docs_of):
    for docs in (table("documents"), edge_docs(docs_of)):
        check_pieces(pack_documents(docs, JSON, with_ids=True).collect(), docs, library())
        check_pieces(pack_documents(docs, JSON, with_ids=True, block_tokens=5000, tails=2).collect(), docs, library())


def test_padding_does_not_follow_the_number_of_tasks(spark, table):
    docs = table("documents", "0.01").select("doc_id", "text").repartition(200, "doc_id")
    lengths = check_pieces(pack_documents(docs, JSON, with_ids=True).collect(), docs, library())
    assert padding_share(lengths) < 0.01


def test_windows_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity = 16
        places = np.cumsum(rng.integers(1, 9, rng.integers(1, 12)))
        cost = rng.integers(0, 5, len(places)).astype(float)
        at, best = [0, *places.tolist()], [0.0]
        pad = lambda n: 0 if n & (n - 1) == 0 else capacity - n
        for j in range(1, len(at)):
            best.append(min(best[i] + pad(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= capacity) + cost[j - 1] + 2.0)
        ends = [0, *best_windows(places, cost, capacity, 2.0).tolist()]
        price = dict(zip(at[1:], cost))
        assert ends[-1] == at[-1] and max(np.diff(ends)) <= capacity
        assert sum(pad(b - a) + price[b] + 2.0 for a, b in zip(ends, ends[1:])) == best[-1]
        last = min(best[i] for i in range(len(at) - 1) if at[-1] - at[i] <= capacity) + cost[-1] + 2.0
        ends = [0, *best_windows(places, cost, capacity, 2.0, True).tolist()]
        assert sum((pad(b - a) if b < at[-1] else 0) + price[b] + 2.0 for a, b in zip(ends, ends[1:])) == last
