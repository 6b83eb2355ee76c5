"""Alignments against plain loops over token ends, and counts against plain dictionaries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyframe.llm import alignment
from tallyframe.llm.queries import QUERIES, vocabulary
from tallyframe.llm.tokens import TokenSide, byte_level_side, piece_side

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
BYTES.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=MODEL)
A, B = byte_level_side(*vocabulary("byte_bpe_50k")), piece_side(MODEL)


def byte_alphabet():
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [i for i in range(256) if i not in plain]
    return {chr(i): i for i in plain} | {chr(256 + k): i for k, i in enumerate(others)}


ALPHABET = byte_alphabet()


def plain_tokens(text):
    """(id, bytes) of both sides, or nothing where they do not join to a space and the text."""
    if not text:
        return [], []
    a = [(i, bytes(ALPHABET[c] for c in BYTES.id_to_token(i))) for i in BYTES.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in PIECES.encode(text):
        piece = PIECES.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if PIECES.is_byte(i) else piece.replace("▁", " ").encode()
        b.append((i, raw))
    whole = (" " + text).encode()
    if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
        return [], []
    return a, b


def plain_groups(text):
    a, b = plain_tokens(text)
    ends = [set(), set()]
    for side, found in zip((a, b), ends):
        at = 0
        for _, raw in side:
            at += len(raw)
            found.add(at)
    common, groups = ends[0] & ends[1], []
    for side in (0, 1):
        at, cut = 0, [[]]
        for i, raw in (a, b)[side]:
            at += len(raw)
            cut[-1].append(i)
            if at in common:
                cut.append([])
        groups.append(cut[:-1])
    return list(zip(*groups))


def plain_statistics(texts):
    groups = {k: plain_groups(t) for k, t in texts.items()}
    links = {k: Counter((x, y) for a, b in found for x in a for y in b) for k, found in groups.items()}
    held = Counter(pair for found in links.values() for pair in found)
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    rows = {}
    for k, found in groups.items():
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        rows[k] = (
            sum(len(a) for a, _ in found),
            sum(len(b) for _, b in found),
            len(found),
            sum(links[k].values()),
            sum(n for pair, n in links[k].items() if held[pair] == highest[pair[0]]),
            sum(n * held[pair] for pair, n in links[k].items()),
            hashlib.sha256(line.encode()).hexdigest() if line else "",
        )
    return rows


def read(rows):
    return {
        r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
        for r in rows
    }


TEXTS = st.text(
    st.sampled_from("aeEß é'sll0٣²½_-.\n\t\r\x0b\x1c\x85\xa0　漢字カター😀́▁<>|") | st.characters(exclude_categories=["Cs"]),
    max_size=40,
)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_groups_are_those_of_a_plain_walk(texts):
    found = alignment.align_texts(texts, A, B)
    want = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain_groups(t)) for t in texts]
    assert alignment.group_texts(found, A, B) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.lists(st.integers(0, 60), max_size=20), st.randoms())
def test_gallop_finds_the_lowest_place_from_any_guess(ends, values, random):
    ends = np.array(sorted(ends))
    values = np.array([v for v in values if v <= ends[-1]], np.int64)
    zeros = np.zeros(len(values), np.int64)
    guess = np.array([random.randrange(len(ends)) for _ in values], np.int64)
    found = alignment.gallop(values, ends, zeros, zeros + len(ends) - 1, guess)
    assert found.tolist() == np.searchsorted(ends, values).tolist()


def one_byte_side(text_ids):
    """A side of our own: ids of fixed pieces, to make groups of many tokens."""
    table = [bytes([i]) for i in range(256)] + [b" " + b"x" * 40 + b"y" * 40]
    return TokenSide(lambda texts: [text_ids(t) for t in texts], table)


def test_large_groups_pair_distinct_ids():
    text = "x" * 40 + "y" * 40
    single = one_byte_side(lambda t: list((t if t.startswith(" ") else " " + t).encode()))
    whole = one_byte_side(lambda t: [256])
    found = alignment.align_texts([text, text], single, whole)
    starts, pairs, links, totals = alignment.linked_pairs(found)
    assert totals.tolist() == [81, 81] and starts.tolist() == [0, 3, 6]
    assert sorted(links.tolist()) == [1, 1, 40, 40, 40, 40]
    assert {p >> alignment.PAIR_BITS for p in pairs.tolist()} == {32, 120, 121}


EDGES = {
    1: "The quick brown fox, über-naïve. 漢字カタカナー test",
    2: None,
    3: "",
    4: " ",
    5: "a▁b",  # joined pieces differ from the text
    6: "<|endoftext|> <s> <0x41>\n\n\ttabs  and   runs",
    7: "The quick brown fox, again and again",
    8: "The quick brown fox, again and again",
    9: "word " * 30_000 + "z" * 3_000,
    10: "\x00nul",
    11: "😀" * 50 + " " * 300,
}


def test_statistics_are_those_of_plain_dictionaries(spark):
    df = spark.createDataFrame(list(EDGES.items()), "doc_id bigint, text string").repartition(3)
    df = df.selectExpr("*", "'x' AS row", "1 AS pair", "2 AS pairs", "3 AS n_a", "'y' AS links")
    sides = (lambda: byte_level_side(*vocabulary("byte_bpe_50k"))), (lambda: piece_side(MODEL))
    want = plain_statistics(EDGES)
    assert read(alignment.link_statistics(df, *sides).collect()) == want
    assert want[5] == (0, 0, 0, 0, 0, 0, "")
    alignment_rows = {r.doc_id: r for r in alignment.align(df, *sides).collect()}
    for key, text in EDGES.items():
        row, groups = alignment_rows[key], plain_groups(text)
        assert np.diff([0, *row.a_until]).tolist() == [len(a) for a, _ in groups]
        assert np.diff([0, *row.b_until]).tolist() == [len(b) for _, b in groups]
        assert row.a_ids == [i for a, _ in groups for i in a]
        assert not groups or row.bytes_until[-1] == len(text.encode()) + 1


def test_both_ways_of_meeting_the_counts_agree(spark, monkeypatch):
    df = spark.createDataFrame([(k, t) for k, t in EDGES.items() if k != 9], "doc_id bigint, text string")
    sides = (lambda: byte_level_side(*vocabulary("byte_bpe_50k"))), (lambda: piece_side(MODEL))
    hinted = read(alignment.link_statistics(df, *sides).collect())
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert read(alignment.link_statistics(df, *sides).collect()) == hinted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_rows_null_ids_and_empty_table(spark):
    sides = (lambda: byte_level_side(*vocabulary("byte_bpe_50k"))), (lambda: piece_side(MODEL))
    rows = [(1, "same text"), (1, "same text"), (None, "same")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_best, r.count_sum) for r in alignment.link_statistics(df, *sides).collect())
    assert got == [(0, 1, 3), (1, 2, 5), (1, 2, 5)]
    assert alignment.link_statistics(df.limit(0), *sides).collect() == []


def test_query_is_the_plain_result(spark, tmp_path):
    from pathlib import Path

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("driver tables not here")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert read(QUERIES["op13_galloping_alignment"](spark, folder).collect()) == plain_statistics(texts)
