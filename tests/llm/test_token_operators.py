"""Byte-level BPE, alignment of tokenizers and collocations, against the tokenizers' libraries and plain versions."""

import hashlib
import json
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tapestream.llm import alignment, byte_bpe, collocations, segments
from tapestream.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids long, a int, b int, n int"
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", "  a  b ", "a \n b", "a \n  b\t 　 c", "x" * 20_000, "the of, " * 3000, "<|endoftext|><s> </s> <0x41> ▁ a▁ b",
       "it's  't're \x00 \x1c\x85  ", "՘࢏ a౜ ᇞ0 ⅧⅫ", "ﬁ Ａ é 😂😂 हिन्दी", "\r\n;\r  ()\r\n"]
ALPHABET = "abé's't 'll\n ,.!1२Ⅷ ŠİΣς́ \x1c\x85😂  ՘▁e;\r("


def random_texts(n, seed=3, longest=80):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def documents(spark, texts):
    """The texts, some rows again, a null id, and columns with names that operators use."""
    rows = [(i, t, "en", None, 0, 1, 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:6] + [(None, "no id", None, "a", 0, 1, 2, 3, 4)], SCHEMA)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_segments_are_the_texts():
    texts = ODD + random_texts(500)
    codes, distinct, bounds = segments.split(pa.array(texts))
    distinct = distinct.to_pylist()
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        own = [distinct[c] for c in codes[a:b]]
        assert "".join(own) == (text or "") and [s[1:] if i else s for i, s in enumerate(own)] == segments.CUT.split(text or "")
    codes, distinct, bounds = segments.split(pa.array(texts), " ")
    distinct = distinct.to_pylist()
    assert ["".join(distinct[c] for c in codes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])] == [" " + (t or "") for t in texts]
    assert segments.split(pa.array([], pa.string()))[2].tolist() == [0]


def test_slices_of_a_batch_give_what_their_texts_give():
    texts = pa.array(random_texts(400, 6, 3000))
    for a, b in ((0, 100), (100, 250), (250, 400)):
        sliced, own = texts.slice(a, b - a), pa.array(texts.slice(a, b - a).to_pylist())
        for read in (lambda t: segments.split(t)[:2], lambda t: segments.split(t, " ")[:2], lambda t: collocations.words_of(t)[:2]):
            (codes, distinct), (want_codes, want) = read(sliced), read(own)
            assert codes.tolist() == want_codes.tolist() and list(distinct) == list(want)


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 20_000, dtype=np.uint64))
    found = byte_bpe.MinimalPerfectHash(keys)
    assert found.size == len(keys) and sorted(found(keys).tolist()) == list(range(len(keys)))
    assert (found(rng.integers(0, 2**64, 1000, dtype=np.uint64)) < len(keys)).all()
    assert byte_bpe.MinimalPerfectHash(keys[:0])(keys[:3]).tolist() == [-1] * 3
    with pytest.raises(ValueError, match="one hash"):
        byte_bpe.MinimalPerfectHash(np.array([5, 5], np.uint64))


@pytest.fixture(scope="module")
def multi():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_library_s(multi, monkeypatch):
    path, library = multi
    bpe = byte_bpe.byte_bpe(path, public_tokenizers.PATTERN)
    texts = [t or "" for t in ODD + random_texts(3000)]
    assert bpe.encode(texts) == [library.encode_ordinary(t) for t in texts]
    assert all(bpe.decode(ids) == t.encode() for t, ids in zip(texts, bpe.encode(texts)))
    monkeypatch.setattr(segments, "MEMO_ENTRIES", 40)  # a new generation each time
    for k in range(0, len(texts), 50):
        assert bpe.encode(texts[k : k + 50]) == [library.encode_ordinary(t) for t in texts[k : k + 50]]


def test_hostile_runs_take_no_square_time(multi):
    path, library = multi
    bpe = byte_bpe.byte_bpe(path, public_tokenizers.PATTERN)
    for text in ("a" * 300_000, " " * 300_000, "ab" * 100_000, "é" * 100_000):
        assert bpe.encode([text]) == [library.encode_ordinary(text)]


def test_digests_of_odd_rows_and_the_query(spark, multi):
    path, library = multi
    docs = documents(spark, ODD)
    got = byte_bpe.digests(docs, path, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def want(rows):
        out = []
        for r in rows:
            ids = library.encode_ordinary(r.text or "")
            out.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or "")))
        return Counter(out)

    assert Counter(map(tuple, got.collect())) == want(docs.collect())
    assert byte_bpe.digests(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.text)) for r in back.collect()) == Counter((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    assert Counter(map(tuple, QUERIES["op12_two_tier_bpe"](spark, SF).collect())) == want(spark.read.parquet(f"{SF}/documents.parquet").collect())


@pytest.fixture(scope="module")
def sides():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path_a, path_b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    a, b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    with open(path_a, encoding="utf-8") as f:
        vocab = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in printable]
    symbols = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}

    def encode(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts_a = [bytes(symbols[c] for c in vocab[i]) for i in ids_a]
        parts_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        return ids_a, ids_b, parts_a, parts_b

    return path_a, path_b, encode


def aligned_by_brute_force(rows, encode):
    """Each row's result as a tuple in the order of the columns."""
    found, holders = [], Counter()
    for r in rows:
        groups, text = [], r.text or ""
        if text:
            ids_a, ids_b, parts_a, parts_b = encode(text)
            if b"".join(parts_a) == b"".join(parts_b) == b" " + text.encode():
                ends_a, ends_b = np.cumsum([len(p) for p in parts_a]), np.cumsum([len(p) for p in parts_b])
                both = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
                groups = [([], []) for _ in both]
                for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
                    for i, g in zip(ids, np.searchsorted(both, ends)):
                        groups[g][side].append(i)
        links = [(a, b) for own_a, own_b in groups for a in own_a for b in own_b]
        holders.update(set(links))
        found.append((r.doc_id, groups, links))
    most = Counter()
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    out = []
    for doc, groups, links in found:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        best = sum(holders[x] == most[x[0]] for x in links)
        out.append((doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), best, sum(holders[x] for x in links), sha(text) if groups else ""))
    return Counter(out)


def test_alignment_against_brute_force(spark, sides):
    path_a, path_b, encode = sides
    for docs, more in ((documents(spark, ODD), {}), (documents(spark, ODD + random_texts(400)).repartition(5), {"share_blocks": 1}), (documents(spark, random_texts(300, 8)).repartition(3), {"buckets": 7, "share_blocks": 2})):
        got = alignment.align(docs, path_a, path_b, public_tokenizers.PATTERN, **more)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert Counter(map(tuple, got.collect())) == aligned_by_brute_force(docs.collect(), encode)
    assert alignment.align(documents(spark, ODD).limit(0), path_a, path_b, public_tokenizers.PATTERN).count() == 0


def test_the_alignment_query_against_brute_force(spark, sides):
    got = QUERIES["op11_postings_cogroup"](spark, SF).collect()
    assert Counter(map(tuple, got)) == aligned_by_brute_force(spark.read.parquet(f"{SF}/documents.parquet").collect(), sides[2])


def test_packed_numbers_come_back():
    for numbers in ([], [0], [255, 0], [256], [70_000, 1], [2**40, 3]):
        assert alignment.unpacked(alignment.packed(np.array(numbers, np.int64))).tolist() == numbers


def collocations_by_brute_force(rows, least, longest=4, first=2000, absorbed=80):
    counts, totals = Counter(), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    frequent = {key: a for key, a in counts.items() if len(key) > 2 and a >= least}
    rows = {}
    for key, a in frequent.items():
        lang, words = key[0], key[1:]
        holders = [f for other, f in frequent.items() if other[0] == lang and len(other) > len(key) and any(other[i : i + len(words)] == words for i in range(1, len(other)))]
        if not any(100 * f >= absorbed * a for f in holders):
            cuts = [(2_000_000 * a // (counts[(lang, *words[:k])] + counts[(lang, *words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[(lang, *words[:k])], counts[(lang, *words[k:])]))
    out = Counter()
    for lang, own in rows.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:first], 1):
            out[(lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)] += 1
    return out


def phrases(n, seed, langs=("en", None, "de")):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "CITY", "é", "\x00", "a.b", "stock,", "market\n", "\x1c", "zzz"]
    texts = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        body[::7] = ["new\tyork city hall"] * len(body[::7])
        texts.append((i, rng.choice((" ", "  ")).join(body), rng.choice(langs), None, 0, 1, 2, 3, 4))
    return texts


def test_collocations_against_brute_force(spark):
    rows = phrases(60, 1) + [(900 + i, t, None, "s", 0, 1, 2, 3, 4) for i, t in enumerate(ODD)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for limits in ({"least": 30}, {"least": 5, "first": 7}, {"least": 12, "absorbed": 50}, {"least": 2000}):
        want = collocations_by_brute_force(docs.collect(), **limits)
        got = collocations.collocations(docs, **limits)
        assert got.columns == names and Counter(map(tuple, got.collect())) == want
        by_shuffle = collocations.collocations(docs, **limits, most_sent=0)
        assert Counter(map(tuple, by_shuffle.collect())) == want
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_counts_are_let_go_when_a_worker_holds_many(spark, monkeypatch):
    docs = spark.createDataFrame(phrases(40, 5), SCHEMA).repartition(2)
    want = sorted(collocations.frequent_phrases(docs, 10)[0].collect())
    encoded = collocations.words_of(pa.array(["A b.C\td,,", None, "e"]))
    assert [encoded[1][c] if c >= 0 else None for c in encoded[0]] == ["a", "b", None, "c", "d", None, None, None, None, "e", None]
    assert sorted(collocations.frequent_phrases(docs, 10, most_sent=0)[0].collect()) == want
    monkeypatch.setattr(collocations, "HELD", 8)
    assert sorted(collocations.frequent_phrases(docs, 10)[0].collect()) == want


def test_products_beyond_64_bits(spark):
    huge = 9_000_000_000_000
    rows = [("en", "a", 1, huge), ("en", "b", 1, huge + 7), ("en", "a b", 2, huge - 5)]
    got = collocations.scored(spark.createDataFrame(rows, collocations.LEVEL)).first()
    assert got.score == 2_000_000 * (huge - 5) // (2 * huge + 7) and (got.l, got.r) == (huge, huge + 7)


def test_the_collocation_query_and_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op13_apriori_collocations"])
    got = QUERIES["op13_apriori_collocations"](spark, SF).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert Counter(map(tuple, got.collect())) == collocations_by_brute_force(rows, 30)
