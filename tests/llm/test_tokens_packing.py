import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from loamdex.llm.packing import Packer, pack
from loamdex.llm.tokens import Coder, token_counts, tokenizer_path

from .util import AWKWARD, docs


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_match_the_library(spark, library):
    got = token_counts(docs(spark, AWKWARD)).collect()
    want = sorted((str(i), len((t or "").encode()), len(ids_of(library, t)), len(ids_of(library, t)) > 2048) for i, t in AWKWARD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_empty_table(spark):
    assert token_counts(docs(spark, AWKWARD).limit(0)).count() == 0
    assert pack(docs(spark, AWKWARD).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_coder_equals_library(texts):
    coder = test_coder_equals_library.coder = getattr(test_coder_equals_library, "coder", None) or Coder(tokenizer_path(), [b"the"], cached=50)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.texts([t.encode() for t in texts])] == [coder._ids(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.integers(1, 6))
def test_packer_keeps_everything_in_bounded_space(lengths, open_bins):
    packer, bins = Packer(64, open_bins), []
    for i, n in enumerate(lengths):
        bins += packer.add((i, n), n)
        assert packer.count <= open_bins
    bins += packer.rest()
    assert sorted(i for items, _ in bins for i, _ in items) == list(range(len(lengths)))
    assert all(sum(n for _, n in items) == used <= 64 for items, used in bins)


def test_best_fit_takes_the_fullest_that_fits():
    packer = Packer(10, 4)
    for i, n in enumerate((4, 7, 8)):
        assert packer.add(i, n) == []
    assert packer.add(3, 3) == [([1, 3], 10)]


def test_pack_round_trip(spark, library):
    rows = pack(docs(spark, AWKWARD), capacity=512, with_ids=True).collect()
    by_doc = {}
    for i, t in AWKWARD:
        by_doc.setdefault(i, []).append([*ids_of(library, t), 1])
    for i, texts in by_doc.items():
        mine = [r for r in rows if r.doc_id == i]
        assert sum(r.length for r in mine) == sum(map(len, texts))
        for r in mine:
            want = texts[0][r.start : r.start + r.length]
            assert r.start == r.piece * 512 and np.frombuffer(bytes(r.ids), "<u4").tolist() == want
            assert zlib.crc32(np.asarray(want, "<u4").tobytes()) == r.ids_crc32
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 512) + 1


def test_second_pass_closes_no_bin_early(spark):
    rows = [(i, "a " * (1 + i * 23 % 50)) for i in range(200)]
    got = pack(docs(spark, rows).repartition(50), capacity=64, open_bins=2).collect()
    assert sorted((r.doc_id, r.piece) for r in got) == [(r[0], 0) for r in rows]
    assert max(r.offset + r.length for r in got) <= 64
    assert len({r.sequence_id for r in got}) <= 1.1 * sum(r.length for r in got) / 64


def test_packer_equals_a_naive_best_fit():
    """Piece by piece against a scan of all open bins: the bin of least free space that takes the piece; the fullest closes when too many are open."""
    rng = random.Random(6)
    for most in (3, 10, 10_000):
        packer, bins, naive, got = Packer(100, most), [], [], []
        for i in range(500):
            length = rng.choice((rng.randint(1, 100), rng.randint(1, 30)))
            got += [(sorted(x), used) for x, used in packer.add(i, length)]
            fitting = [b for b in bins if b[0] >= length]
            if length == 100:
                naive.append(([i], 100))
                continue
            if fitting:
                best = max((b for b in bins if b[0] == min(f[0] for f in fitting)), key=lambda b: b[2])
            else:
                if len(bins) >= most:
                    fullest = max((b for b in bins if b[0] == min(x[0] for x in bins)), key=lambda b: b[2])
                    bins.remove(fullest)
                    naive.append((sorted(fullest[1]), 100 - fullest[0]))
                best = [100, [], 0]
                bins.append(best)
            best[0] -= length
            best[1].append(i)
            best[2] = i  # of equally full bins the one that was touched last
            if not best[0]:
                bins.remove(best)
                naive.append((sorted(best[1]), 100))
        got += [(sorted(x), used) for x, used in packer.rest()]
        naive += [(sorted(b[1]), 100 - b[0]) for b in bins]
        assert sorted(got) == sorted(naive)
