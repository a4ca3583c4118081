import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairsim.llm import bitpack
from pairsim.llm.queries import END_ID, TOKENIZER
from tests.llm.helpers import frame

TOK = Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 31, 32])
def test_pack_round_trip_and_random_access(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 2**width, 10_001, dtype=np.uint64).astype(np.uint32)
    starts = np.array([0, 0, 17, 4096, 9000, 10_001])
    f = bitpack.PackedFile(bitpack.to_file(ids, starts, width))
    assert (f.ids(0, f.n_ids) == ids).all()
    for a, b in [(0, 0), (5, 6), (4090, 4100), (8191, 10_001)]:
        assert (f.ids(a, b) == ids[a:b]).all()
    assert (f.doc(3) == ids[4096:9000]).all() and len(f.doc(0)) == 0


PIECES = st.text(st.sampled_from(list("ab Él\n\t   \x1c<|'s1!.,×")), max_size=30)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.none(), PIECES, st.just("x <|endoftext|> y")), min_size=1, max_size=6))
def test_pieces_give_the_ids_of_the_whole_text(texts):
    ids, n = bitpack.Encoder(TOKENIZER)(pa.array(texts, pa.string()))
    parts = np.split(ids, np.cumsum(n)[:-1])
    assert [p.tolist() for p in parts] == [TOK.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_spans_against_a_plain_loop(spark):
    rows = [(9, "hello  world"), (3, None), (-4, ""), (None, "no id"), (3, "twice the id"), (12, "long text " * 5000), (9, "hello  world")]
    docs = frame(spark, rows)
    for file_ids, parts in ((10, 3), (10**6, None)):
        got = bitpack.encode_and_read(docs, TOKENIZER, END_ID, file_ids=file_ids, parts=parts).collect()
        at, want = 0, []
        for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
            ids = np.array([*TOK.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4")
            want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_table(spark):
    assert bitpack.encode_and_read(frame(spark, []), TOKENIZER, END_ID).collect() == []
