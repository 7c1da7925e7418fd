"""Operators on single texts, against the libraries and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sparkscreen.llm import bpe_automaton, decontaminate, gru_lm, quality_crf, secret_scan, token_counts, token_store
from sparkscreen.llm.queries import tokenizer_path

ODD = [None, "", " ", "a", "Hello  world\n\n", "tab\tand space 　", "naïve café ß ΣΣς İ", "漢字 and \U0001f600 emoji", "a<|endoftext|>b <|startoftext|>", "don't they'll 're 123 4,5", "x" * 3000, "ab " * 2000, "\x1c \x00 \x85 end ", "aaaa aaaaa nananana"]
SCHEMA = "doc_id long, extra string, text string, content string, own string, row long"


def frame(spark, texts, ids=None):
    """Rows with clashing extra columns, one repeated row and one null id."""
    ids = ids or list(range(len(texts)))
    rows = [(i, "x", t, "c", "o", 5) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame([*rows, rows[-1], (None, "x", "null id here", "c", "o", 5)], SCHEMA).repartition(3)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    alphabet = [*"abcdehinorst  \n\t1.,'é漢", "<|endoftext|>", " the", "ing"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(60)]


def test_bpe_automaton_equals_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    got = by_id(bpe_automaton.bpe_digests(frame(spark, texts), tokenizer_path("word_bpe_49k.json")))
    assert len(got[len(texts) - 1]) == 2 and len(got[None]) == 1
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[i][0]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = by_id(bpe_automaton.encode_documents(frame(spark, texts), tokenizer_path("word_bpe_49k.json")))
    assert full[9][0]["ids"] == library.encode(texts[9], add_special_tokens=False).ids


def test_words_go_through_the_automaton_side_by_side(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    rng = random.Random(11)
    # Around the length from which words go alone, of one letter, of bytes that no label joins, capitals that fold by context or grow.
    words = ["a" * n for n in (1, 2, 63, 64, 65, 130)] + ["é" * n for n in (31, 32, 33)] + ["漢\U0001f600", "ΑΣ", "ΣΑΣ", "İX", "A\u030a", "'s", "x's", "12", "!?&", "\x1c", "\x00"]
    words += ["".join(rng.choice(["th", "er", "tion", "Éa", "ß", "q", "7", ",", "'re"]) for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    texts = [" ".join(words), "<|endoftext|>".join(words[:400]), *words[:200]]
    # Repeated words, and few places for arcs, so that arcs take each other's.
    monkeypatch.setattr(bpe_automaton, "ARC_PLACES", 1 << 6)
    own = bpe_automaton.WordBpe(path)
    alone, has_arc = [], own.automaton.has_arc
    monkeypatch.setattr(own.automaton, "has_arc", lambda x, y: alone.append(1) or has_arc(x, y))
    for _ in range(2):
        for text, (n, ids, decoded) in zip(texts, own.encode_joined(texts), strict=True):
            expected = library.encode(text, add_special_tokens=False).ids
            assert n == len(expected) and ids == " ".join(map(str, expected)) and decoded == library.decode(expected, skip_special_tokens=False)
    # Only the arcs of the long words are asked for one by one.
    assert 0 < len(alone) < 3000
    states, labels = (np.array([rng.randrange(49406) for _ in range(4000)]) for _ in range(2))
    assert own.automaton.have_arcs(states, labels).tolist() == [has_arc(int(x), int(y)) for x, y in zip(states, labels, strict=True)]


def test_automaton_accepts_exactly_the_tokenization():
    # a+b, then ab+a, then a+a: every word over {a, b} by all paths that the automaton accepts.
    vocab = {"a": 0, "b": 1, "ab": 2, "aba": 3, "aa": 4}
    auto = bpe_automaton.MergeAutomaton([(0, 1, 2), (2, 0, 3), (0, 0, 4)], 5)
    names = {v: k for k, v in vocab.items()}

    def slow(word):
        parts = list(word)
        for pair in (("a", "b"), ("ab", "a"), ("a", "a")):
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == pair:
                    parts[i : i + 2] = ["".join(pair)]
                i += 1
        return parts

    def paths(word, last=None):
        if not word:
            return [[]]
        return [[n, *rest] for i, n in names.items() if word.startswith(n) and (last is None or auto.has_arc(last, i)) for rest in paths(word[len(n) :], i)]

    for n in range(1, 9):
        for k in range(1 << n):
            word = "".join("ab"[k >> j & 1] for j in range(n))
            assert paths(word) == [slow(word)]


def test_prefix_counts_equal_library(spark, texts):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own = token_counts.PrefixCounter(path)
    for t in texts[:40]:
        t = (t or "")[:80]
        table = own.table(t)
        assert table == [len(library.encode(t[:i])) for i in range(len(t) + 1)]
        assert own.cut_for(t, 5) == max(i for i, c in enumerate(table) if c <= 5)
    got = by_id(token_counts.token_counts(frame(spark, texts), path, limit=50))
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i][0]["n_bytes"], got[i][0]["n_tokens"], got[i][0]["over_limit"]) == (len((t or "").encode()), n, n > 50)
    stored = by_id(token_counts.prefix_tables(frame(spark, texts[:12]), path, budgets=(3,)))
    assert token_counts.count_at(stored[7][0]["steps"], 4) == own.table(texts[7])[4]


def test_token_store_round_trip(spark, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    shared = "passage of many documents " * 900
    texts = [*texts, shared, "other " + shared, shared]
    docs = frame(spark, texts)
    got = by_id(token_store.stored_digests(docs, path))
    before = 0
    first = got.pop(None)[0]
    assert first["start"] == 0
    before = first["n_tokens"]
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            before += len(ids)
    from sparkscreen.llm.shared import staging_path

    at = staging_path(spark, "store-test")
    token_store.write_store(docs, path, at)
    rebuilt = by_id(token_store.reconstruct(spark, at))
    assert rebuilt[len(texts) - 1][0]["ids"] == [*library.encode(shared, add_special_tokens=False).ids, 2]
    assert not token_store.verify_manifest(spark, at).take(1)
    stored = spark.read.parquet(f"{at}/chunks")
    assert stored.count() == stored.select("name").distinct().count()
    # A changed chunk is noticed.
    stored.selectExpr("name", "n_ids", "cast(concat(cast('zz' as binary), substring(payload, 3)) as binary) as payload").write.parquet(f"{at}/changed")
    import shutil

    local = at.removeprefix("file:")
    shutil.rmtree(f"{local}/chunks")
    shutil.move(f"{local}/changed", f"{local}/chunks")
    with pytest.raises(Exception, match="can't be verified"):
        token_store.read_digests(spark, at).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_store.stored_digests(none, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert token_counts.token_counts(none, tokenizer_path("piece_bpe_32k.model")).count() == 0
    assert bpe_automaton.bpe_digests(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    assert secret_scan.secret_digests(none).count() == 0
    assert gru_lm.score_documents(none, quality_crf.held_out(2, 7)).count() == 0
    field = quality_crf.fit(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_crf.score_documents(none, field).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    bank = ["alpha", "beta", "Gamma", "δέλτα", "x1", "the", "of"]
    say = lambda n: " ".join(rng.choice(bank) for _ in range(n))
    items = [(1, say(20)), (2, say(13)), (10, say(4)), (3, ""), (4, None), (5, "the"), (6, say(40)), (6, say(14)), (None, say(20))]
    texts = [None, "", "no match at all here", items[0][1], "x " + items[1][1].upper() + ", y", items[2][1] + " " + say(100), items[6][1][:90], *[say(rng.randint(1, 300)) for _ in range(30)], say(50) + "\n" + items[0][1] + "!" + items[6][1]]
    for one_block in (True, False):
        docs = frame(spark, texts)
        index = decontaminate.build_index(docs, block_bytes=1 << 23 if one_block else 700)
        got = by_id(decontaminate.search(index, spark.createDataFrame(items, "item_id long, text string")))
        for i, t in enumerate(texts):
            w, hit, found = words_of(t), set(), set()
            for item, text in items:
                v = words_of(text)
                if item is None or not v:
                    continue
                n = min(13, len(v))
                wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in wins:
                        hit.update(range(k, k + n))
                        found.add(str(item))
            r = got[i][0]
            assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(found)), i
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
            assert {k for s in r["spans"] for k in range(s["start"], s["end"])} == hit


def test_several_query_blocks_give_the_same(spark):
    items = spark.createDataFrame([(k, f"item number {k} says this and that of it") for k in range(30)], "item_id long, text string")
    docs = frame(spark, [f"before item number {k} says this and that of it after" for k in range(30)])
    index = decontaminate.build_index(docs)
    one = by_id(decontaminate.search(index, items))
    assert by_id(decontaminate.search(index, items, most=20)) == one
    assert one[7][0]["n_items"] == 1


def test_proximity(spark):
    texts = ["red green blue", "blue x x green x red", "red x x x x x x green blue", "green red", "blue green red blue"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.proximity(decontaminate.build_index(docs), spark.createDataFrame([(1, "Red green BLUE")], "item_id long, text string"), 6)
    assert {(r["doc_id"], r["end"] - r["start"]) for r in found.collect()} == {(0, 3), (1, 6), (4, 3)}
