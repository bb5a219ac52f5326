"""Operators 1, 2 and 10 against the libraries' own answers and exact round trips."""

import collections
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowloom.llm import common, idfiles, packing, pieces, tokens

from odd_rows import ODD

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "aB zé,.'!\n\t 1\xa0́ΣİK<|>²▁"


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(ALPHABET), max_size=25), max_size=4))
def test_chunks_give_the_tokenizers_own_ids(path, texts):
    table = tokens.encoder(path)
    ids, counts = table.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[e - n:e].tolist() for e, n in zip(ends, counts)] == [table.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_table_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_CHUNKS", 3)
    table = tokens.Chunked(BYTES)
    for text in ("one two three, four.", "one six, seven", "one two eight."):
        assert table.encode([text])[0].tolist() == table.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("text", ["Σİ.", "Σİ, a", "Σ\u0958.", "word)...\" Word?! (a) it's.\" <|endoftext|>. x<|endoftext|>.", "9. é;: 'a'. $a$ a.b."])
def test_marks_after_a_word_are_cut_off_only_where_the_tokenizer_cuts(path, text):
    table = tokens.Chunked(path)
    assert table.encode([text])[0].tolist() == table.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_a_full_table_keeps_the_most_used_chunks(path, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_CHUNKS", 60)
    monkeypatch.setattr(tokens, "BATCH_CHUNKS", 7)
    monkeypatch.setattr(tokens, "BATCH_CHARS", 40)
    table = tokens.Chunked(path)
    table.encode([" ".join(f"early{i}" for i in range(60))])
    for turn in range(40):
        texts = [f"often, {turn}x often. {turn}y", "", f"{turn}z often\n{turn}é."]
        ids, counts = table.encode(texts)
        ends = np.cumsum(counts)
        assert [ids[e - n:e].tolist() for e, n in zip(ends, counts)] == [table.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(table) <= 60
        assert turn < 2 or sum("often" in chunk for chunk in table) >= 3
    assert not any("early" in chunk for chunk in table)


def test_missing_chunks_share_calls_of_the_tokenizer():
    class Counting:
        def __init__(self, own):
            self.own, self.texts = own, 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.own.encode_batch_fast(texts, **options)

    table = tokens.Chunked(BYTES)
    own, table.tokenizer = table.tokenizer, Counting(table.tokenizer)
    text = " ".join(f"word{i}'s x{i}\nCafé{i}, \u0301{i} 9.{i}<|endoftext|> <|endoftext|>{i}!" for i in range(300))
    assert table.encode([text, "bare", text.upper()])[0].tolist() == [i for t in (text, "bare", text.upper()) for i in own.encode(t, add_special_tokens=False).ids]
    assert table.tokenizer.texts < len(table) / 10


def test_a_worker_lets_go_of_the_tables_of_the_operator_before():
    tokens.encoder(WORDS)
    common.let_go("tokens")
    assert tokens._loaded
    common.let_go()
    assert not tokens._loaded


def test_blocks_cut_batches_by_characters():
    texts = ["aaaa", None, "ééé", "", "x" * 20, "b", None]
    batch = pa.record_batch({"k": pa.array(range(7)), "text": pa.array(texts, pa.string())})
    found = [(b.column(0).to_pylist(), t) for b, t in common.blocks([batch, batch.slice(0, 0), batch.slice(2, 2)], 7)]
    assert found == [([0, 1, 2, 3], texts[:4]), ([4], texts[4:5]), ([5, 6], texts[5:]), ([2, 3], texts[2:4])]


def test_files_hold_every_id_in_order(docs):
    shards, _ = idfiles.write_ids(docs(*ODD), BYTES, 2, shards=4)
    rows = idfiles.read_ids(shards).orderBy("start").collect()
    own = Tokenizer.from_file(BYTES)
    want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [i for i, _ in want]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    got = collections.Counter((r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in rows)
    ids = [(i, own.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in ODD]
    assert got == collections.Counter((i, len(x), crc(x)) for i, x in ids)
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    assert (idfiles.ids_at(shards, docs().sparkSession, 5, 40_000) == whole[5:40_005]).all()


def test_matches_of_pieces_by_brute_force():
    table = pieces.Lattice(MODEL)
    texts = ["thes thing  1²é\n▁x", pieces.GAP, "", f"a{pieces.GAP}b", "\ud800日本 in the", "zzz. the,"]
    joined = pieces.GAP.join(texts)
    own = {table.bytes_of[i].decode(): i for i in range(table.size) if i not in table.byte_id and table.bytes_of[i]}
    want = {(b, own[joined[a:b]]) for a in range(len(joined)) for b in range(a + 1, len(joined) + 1) if joined[a:b] in own}
    got = list(zip(*(x.tolist() for x in table.matches(joined))))
    assert len(got) == len(want) and set(got) == want
    start, end, *_ = table.edges(texts)
    assert (np.diff(end) >= 0).all() and (np.diff(start)[np.diff(end) == 0] > 0).all()


def test_no_documents_no_files(docs):
    shards, _ = idfiles.write_ids(docs(), BYTES, 2)
    assert idfiles.read_ids(shards).count() == 0
    assert packing.pack(docs(), WORDS, 1).count() == 0
    assert pieces.decode(pieces.encode(docs(), MODEL), MODEL).count() == 0


def test_packing_places_every_id_once(docs):
    rows = packing.pack(docs(*ODD), WORDS, 1, longest=256, step_ids=1024)
    own = Tokenizer.from_file(WORDS)
    found = rows.collect()
    windows, parts = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        windows[r.sequence_id].append((r.offset, r.length, r.tier, r.step_group))
        parts[r.doc_id, r.doc_tokens].append((r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()))
    for pieces_ in windows.values():
        at = 0
        for offset, length, tier, group in sorted(pieces_):
            assert offset == at and (tier, group) == pieces_[0][2:]
            at += length
        assert at == pieces_[0][2] <= 256 and at & (at - 1) == 0
    assert sorted(windows) == list(range(len(windows)))
    want = collections.Counter((i, len(x), tuple(x)) for i, t in ODD for x in [own.encode(t or "", add_special_tokens=False).ids + [1]])
    for (i, n, ids), copies in want.items():
        pieces_ = sorted(parts[i, n])
        if copies == 1 and sum(1 for j, m, _ in want if (j, m) == (i, n)) == 1:
            assert [x for _, _, p in pieces_ for x in p] == list(ids)
            assert list(itertools.accumulate([0] + [k for _, k, _ in pieces_]))[:-1] == [s for s, _, _ in pieces_]
    assert sum(r.length for r in found) == sum(n * c for (_, n, _), c in want.items())
    groups = collections.Counter()
    for r in found:
        groups[r.step_group, r.tier] += r.length
    assert all(n <= 1024 for n in groups.values())
    whole = packing.sequences(rows).collect()
    assert all(len(s.ids) == 4 * s.tier == 4 * sum(s.lengths) for s in whole)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=40))
def test_pack_block_by_brute_force(sizes):
    windows = packing.pack_block(np.asarray(sizes, np.int64), 64)
    ids = collections.Counter((d, s + k) for w in windows for d, s, n in w for k in range(n))
    assert ids == collections.Counter((d, k) for d, n in enumerate(sizes) for k in range(n))
    lengths = [sum(n for _, _, n in w) for w in windows]
    assert all(n & (n - 1) == 0 and 0 < n <= 64 for n in lengths)
    assert sum(n < 64 for n in lengths) <= 6


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_tiers_are_packed_by_themselves(sizes):
    windows = packing.pack_tiers(np.asarray(sizes, np.int64), 64)
    ids = collections.Counter((d, s + k) for w in windows for d, s, n in w for k in range(n))
    assert ids == collections.Counter((d, k) for d, n in enumerate(sizes) for k in range(n))
    for window in windows:
        tier = sum(n for _, _, n in window)
        assert tier & (tier - 1) == 0 and tier <= 64
        first, *fillers = [n for _, _, n in window]
        assert first > tier // 2 and all(2 * n <= tier for n in fillers)


def test_share_of_sequences_per_tier(docs):
    share = lambda sizes: collections.Counter(sum(n for _, _, n in w) for w in packing.pack_tiers(np.asarray(sizes), 2048))
    assert share([100] * 2000)[128] > 1000 and max(share([100] * 2000)) == 128
    both = share([5000] * 10 + [1500] * 20 + [100] * 2000)
    assert both[2048] == 40 and both[128] > 900 and sum(n * k for n, k in both.items()) == 280_000
    found = packing.pack(docs(*((i, "word " * 99) for i in range(300))), WORDS, 1).select("sequence_id", "tier").distinct().groupBy("tier").count()
    tiers = {r["tier"]: r["count"] for r in found.collect()}
    assert max(tiers) == 128 and tiers[128] > 140


def test_sampled_pieces_decode_to_the_text(docs):
    encoded = pieces.encode(docs(*ODD), MODEL)
    got = pieces.decode(encoded, MODEL).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(ODD)
    again = {(r.doc_id, r.text): r.ids for r in pieces.decode(pieces.encode(docs(*ODD).coalesce(1), MODEL), MODEL).collect()}
    assert all(again[r.doc_id, r.text] == r.ids for r in got)
    other = {(r.doc_id, r.text): r.ids for r in pieces.decode(pieces.encode(docs(*ODD), MODEL, seed=1), MODEL).collect()}
    assert other[6, "word " * 30_000] != again[6, "word " * 30_000]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(ALPHABET + "\U0010ffff\x00"), max_size=30))
def test_pieces_round_trip(text):
    table = pieces.lattice(MODEL)
    ids, counts = table.encode([text], [3])
    assert table.decode(ids, counts) == [text]


def test_segmentations_have_their_weights_chance():
    table = pieces.lattice(MODEL)
    unit, many = " there", 20_000
    known = {t: i for t, i in zip(table.automaton.keys(), table.automaton.values()) if t in unit}
    weights = {}

    def walk(at, path, weight):
        if at == len(unit):
            weights[tuple(path)] = math.exp(weight)
        for t, i in known.items():
            if unit.startswith(t, at):
                walk(at + len(t), [*path, i], weight + table.weight[i])

    walk(0, [], 0.0)
    ids, counts = table.encode([unit[1:]] * many, list(range(many)))
    ends = np.cumsum(counts)
    got = collections.Counter(tuple(ids[e - n:e].tolist()) for e, n in zip(ends, counts))
    total = sum(weights.values())
    for path, weight in weights.items():
        p = weight / total
        assert abs(got[path] / many - p) < 5 * math.sqrt(p / many) + 1e-3
    assert sum(got[p] for p in weights) == many


def test_crc_of_column_is_that_of_ids(spark):
    ids = np.asarray([1, 70_000], "<u4")
    assert spark.range(1).select(F.crc32(F.lit(ids.tobytes()))).first()[0] == crc(ids) == idfiles.crc_of(ids)


def test_decoding_in_slices(docs, monkeypatch):
    monkeypatch.setattr(pieces, "DECODED_IDS", 5)
    got = pieces.decode(pieces.encode(docs(*ODD), MODEL), MODEL).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(ODD)


def test_a_full_lattice_table_changes_nothing(monkeypatch):
    texts = ["one two three, four.", "one six, seven\n", "six two eight. 日", "one two three, four."]
    want = [pieces.lattice(MODEL).encode([t], [5])[0].tolist() for t in texts]
    monkeypatch.setattr(pieces, "KEPT_EDGES", 40)
    table = pieces.Lattice(MODEL)
    assert [table.encode([t], [5])[0].tolist() for t in [*texts, *texts]] == [*want, *want]
    assert len(table.numbers) < 10
