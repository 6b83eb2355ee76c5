import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyframe.llm import packing, token_rollup
from tallyframe.llm.queries import QUERIES, SPECIAL_50K, vocabulary
from tallyframe.llm.tokens import byte_encoder

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PLAIN.encode_special_tokens = True
ENCODE = byte_encoder(*vocabulary("byte_bpe_50k"))


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aeEß é'sll0٣²½_-.\n\t\r\x0b\x1c\x85\xa0　漢字😀́") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_ids_are_those_of_the_plain_tokenizer(text):
    assert ENCODE(text) == struct.pack(f"<{len(plain_ids(text))}I", *plain_ids(text))


@pytest.mark.parametrize(
    "text", ["", " ", "\n", "a b", " a", "a ", "a  b", "a\n b", "a \nb", "it's we'll", "<|endoftext|> x", "x" * 500]
)
def test_ids_at_the_edges(text):
    assert ENCODE(text) == struct.pack(f"<{len(plain_ids(text))}I", *plain_ids(text))


CONTRACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SPECIAL = byte_encoder(*vocabulary("byte_bpe_50k"), SPECIAL_50K)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", ">", " ", "a", "\n", "é", "<|", "the", "1"]), max_size=8))
def test_special_strings_are_those_of_the_tokenizer(parts):
    text = "".join(parts)
    ids = CONTRACT.encode(text, add_special_tokens=False).ids
    assert SPECIAL(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_query_packs_the_ids_of_the_tokenizer(spark, tmp_path):
    texts = {1: "a<|endoftext|>b", 2: "<|endoftext|>" * 1500, 3: None, 4: "plain text"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op3_best_fit_packing"](spark, str(tmp_path)).collect()
    ids = {k: CONTRACT.encode(t or "", add_special_tokens=False).ids + [2] for k, t in texts.items()}
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in rows) == sorted(
        (k, start, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
        for k, all_ids in ids.items()
        for start, part in (
            [(0, all_ids)] if len(all_ids) <= 1024 else [(0, all_ids[: len(all_ids) % 1024]), (len(all_ids) % 1024, all_ids[-1024:])]
        )
    )


def check_packing(rows, texts, capacity, end=2):
    ids = {k: plain_ids(t) + [end] for k, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *part))
    assert set(pieces) == set(texts)
    for key, found in pieces.items():
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found)))
        assert [r.length for r in found[1:]] == [capacity] * (len(found) - 1)
        total = 0
        for r in found:
            assert r.start == total
            total += r.length
        assert total == len(ids[key])
    for found in sequences.values():
        found.sort(key=lambda r: r.offset)
        total = 0
        for r in found:
            assert r.offset == total
            total += r.length
        assert total <= capacity
    return len(sequences)


def test_packing_round_trip(spark):
    texts = {i: "word " * (i * 7 % 90) + "end" for i in range(200)}
    texts |= {300: None, 301: "", 302: "long text here " * 900}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    df = df.selectExpr("*", "'x' AS length", "1 AS piece", "2 AS rank", "'n' AS part")
    rows = packing.pack(df, *vocabulary("byte_bpe_50k"), capacity=128).collect()
    used = check_packing(rows, texts, 128)
    total = sum(len(plain_ids(t)) + 1 for t in texts.values())
    assert used <= 1.05 * total / 128 + 1


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x")], "doc_id bigint, text string")
    rows = packing.pack(df, *vocabulary("byte_bpe_50k")).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (1, 2), (1, 2)]
    assert len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows) == [0, 2, 4]
    assert packing.pack(df.limit(0), *vocabulary("byte_bpe_50k")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 5000), max_size=30))
def test_best_fit_is_that_of_one_by_one(counts):
    runs = packing.best_fit(counts, 64)
    fill = defaultdict(int)
    placed = defaultdict(int)
    for length, rank, n, first, offset in runs:
        assert rank == placed[length]
        placed[length] += n
        for s in range(first, first + n):
            assert fill[s] == offset
            fill[s] += length
    assert dict(placed) == counts and all(f <= 64 for f in fill.values())
    gaps = []  # plain best fit, one document after the other, on small cases
    if sum(counts.values()) <= 2000:
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [g for g in gaps if g >= length]
                gap = min(fits) if fits else 64
                if fits:
                    gaps.remove(gap)
                gaps.append(gap - length)
        assert len(gaps) == len(fill)


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    rows = [("a", "en", "v1", 5), ("a", "en", "v1", 7), ("b", None, "v1", 0), (None, "de", "v2", 3)]
    counts = spark.createDataFrame(rows, "source string, lang string, tokenizer string, tokens bigint")
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert rollup.totals().collect() == []
    assert rollup.commit("one", token_rollup.inserts(counts))
    assert not rollup.commit("one", token_rollup.inserts(counts))
    found = lambda: {tuple(r) for r in rollup.totals().collect()}
    assert found() == {("a", "en", "v1", 2, 12), ("b", None, "v1", 1, 0), (None, "de", "v2", 1, 3)}
    gone = counts.where("tokens = 7")
    assert rollup.commit("two", token_rollup.deletes(gone))
    assert rollup.commit("three", token_rollup.revisions(counts.where("tokens = 3"), counts.where("tokens = 3").selectExpr("source", "lang", "'v3' AS tokenizer", "4L AS tokens")))
    assert found() == {("a", "en", "v1", 1, 5), ("b", None, "v1", 1, 0), (None, "de", "v3", 1, 4)}
    assert rollup.commit("four", token_rollup.inserts(counts.limit(0)))
    again = token_rollup.TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert again.batches() == ["batch=four", "batch=one", "batch=three", "batch=two"]
    (tmp_path / "rollup" / "batch=two" / "_SUCCESS").unlink()  # as if it had broken off
    assert again.commit("two", token_rollup.deletes(gone))
    assert ("a", "en", "v1", 1, 5) in found()


def test_token_counts(spark):
    texts = [(1, "s", "en", "Hello there, it's me"), (2, None, None, None), (3, "s", "en", ""), (1, "s", "en", "Hello there, it's me")]
    df = spark.createDataFrame(texts, "doc_id bigint, source string, lang string, text string").selectExpr("*", "9 AS tokens", "'t' AS tokenizer")
    rows = token_rollup.count_tokens(df, {"v": vocabulary("byte_bpe_50k")}).collect()
    assert sorted((r.doc_id, r.tokens, r.chars) for r in rows) == sorted(
        (i, len(plain_ids(t)), len(t or "")) for i, _, _, t in texts
    )
    assert token_rollup.count_tokens(df.limit(0), {"v": vocabulary("byte_bpe_50k")}).collect() == []


def test_a_gap_is_filled_up_before_the_next_of_its_size():
    runs = packing.best_fit({4: 15, 5: 16, 22: 11}, 64)
    assert len({s for _, _, n, first, _ in runs for s in range(first, first + n)}) == 6
