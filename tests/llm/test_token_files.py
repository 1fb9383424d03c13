"""Token files: the word coding, the file, ids against the tokenizer."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF001
from tickframe.llm import queries
from tickframe.llm import token_files as T

U = np.uint64


def exact(rows):
    """(doc_id, start, n_tokens, crc) by the tokenizer on whole texts, in file order."""
    tok = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def key(r):
    return (r[1], r[0] is None, r[0] or 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 60000), st.integers(0, 2 ** 64 - 1)), max_size=300),
       st.integers(0, 500))
def test_round_trip(values, zeros):
    ids = np.array([*values, *[0] * zeros], U)
    words, exceptions = T.pack(ids)
    assert (T.unpack(words, exceptions) == ids).all() and len(exceptions) == sum(v >= 2 ** 60 for v in values)


def test_words_are_full():
    for count, bits in T.LAYOUT[2:]:
        assert len(T.pack(np.full(count * 7, (1 << bits) - 1, U))[0]) == 7
    assert len(T.pack(np.zeros(2400, U))[0]) == 10


def test_file_reads_spans_and_documents():
    rng = np.random.default_rng(1)
    counts = np.array([1, 700, 1, 3, 64, 64, 1, 900, 5])
    ids = rng.integers(0, 50000, counts.sum()).astype(U)
    ids[[5, 400, 801]] = [2 ** 63, 2 ** 60, 2 ** 64 - 1]
    stream = io.BytesIO()
    w = T.Writer(stream, 64)
    at = 0
    for k in range(0, len(counts), 2):
        n = int(counts[k:k + 2].sum())
        w.add([None if i == 0 else i for i in range(k, min(k + 2, len(counts)))], ids[at:at + n], counts[k:k + 2])
        at += n
    w.close()
    size = stream.tell()
    f = T.TokenFile(stream, size)
    assert f.counts.tolist() == counts.tolist() and not f.present[0] and f.present[1:].all() and f.n_ids == len(ids)
    for a, b in [(0, len(ids)), (63, 65), (700, 701), (5, 5), (1, 802), (len(ids) - 1, len(ids))]:
        assert (f.ids(a, b) == ids[a:b]).all()
    for run in (1, 3, 1000):
        seen = np.zeros(len(counts), int)
        for first, last, low, got in f.documents(run):
            assert (got == ids[low:low + len(got)]).all()
            for d in range(first, last):
                seen[d] += min(f.start[d] + f.counts[d], low + len(got)) - max(f.start[d], low)
        assert (seen == counts).all()
    stream.seek(0)
    data = stream.read(size)
    assert zlib.crc32(data[:-T.FOOTER_SIZE]) == f.crc
    with pytest.raises(ValueError):
        T.TokenFile(io.BytesIO(data[:-1]), size - 1)


def test_odd_rows(spark):
    rows = [(3, None, 5), (2, "", 6), (9, "<|endoftext|> x<|startoftext|>.y <|endoftext|", 7), (4, "Naïve  “quoted” 漢字 \x85 ''s don't. I'll ́a e\u0301 x\u0301.", 8),
            (5, "ab c, " * 30000, 9), (6, "same text.", 1), (6, "same text.", 1), (6, "another", 1), (None, "no id", 2), (7, " \n\n  x\t\ty . ,", 3),
            (-8, "İΣ ΑΣ. 'S 'RE.'ve a.'s b!?'t ...'m 12,5 A.B", 4), (10, "\u3000wide\u00a0space\u2028line\x0bv\x0cf", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = T.token_files(docs, keep_ids=True).collect()
    assert sorted([tuple(r)[:4] for r in got], key=key) == exact([r[:2] for r in rows])
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    several = T.token_files(docs, file_bytes=200, block=8).collect()
    assert sorted(map(tuple, several), key=key) == exact([r[:2] for r in rows])
    assert T.token_files(docs.limit(0)).count() == 0


def test_files_and_manifest(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    folder, manifest = T.write(docs, f"file://{tmp_path}/out", file_bytes=60000)
    files = sorted(manifest.collect(), key=lambda r: r.shard)
    assert len(files) > 3 and sorted(p.name for p in (tmp_path / "out").iterdir()) == [r.path for r in files]
    at, last = 0, -1
    for r in files:
        with open(tmp_path / "out" / r.path, "rb") as f:
            file = T.TokenFile(f, r.bytes)
            assert r.start == at and r.n_tokens == file.n_ids and r.n_docs == len(file.counts)
            assert file.doc_id[0] > last and (np.diff(file.doc_id) >= 0).all()
            at, last = at + file.n_ids, file.doc_id[-1]
            assert r.bytes < 2.6 * file.n_ids + 20000


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_token_files"](spark, SF001).collect()), key=key) == exact(rows)
