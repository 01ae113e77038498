import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_data import ODD, no_docs, odd_docs

from ledgerloom.llm import queries, separator_scan, token_files
from ledgerloom.session import shared_folder

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [
    "", None, "a", " a", "a  b", "a \n b", "x\n\ny  ", "don't  'll '", "  ", "\tq r", "a b c", "<|endoftext|> hi", "hello <|endoftext|> world", "a<|endoftext|>b <|endoftext|>", "a  <|endoftext|>", "<|endoftext|>  b", "é 中文 字 a",
    "tab\t b", "end ", " ", "\x1c x \x85 y", "a " * 50, "a  b", "   x", "word " * 2000 + "z",
]


def test_pieces_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = queries.byte_bpe()
    for _ in range(2):  # the second time from memory
        ids, counts = encoder.batch(pa.array(TEXTS))
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [whole.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


@pytest.mark.parametrize("distinct", [1, 3, 256, 257, 70_000, 17_000_000])
def test_pack_round_trip(distinct):
    rng = np.random.default_rng(distinct)
    for n in (0, 1, 3, 4, 1001):
        ids = rng.integers(0, distinct, n).astype(np.uint32)
        ranked, control, data = token_files.pack(ids)
        assert len(control) == -(-n // 4)
        assert (token_files.unpack(ranked, control, data, n) == ids).all()


def test_pack_uses_wider_ranks():
    ids = np.arange(70_000, dtype=np.uint32)
    ranked, control, data = token_files.pack(ids)
    assert len(data) == 256 + 2 * (65_536 - 256) + 3 * (70_000 - 65_536)
    assert (token_files.unpack(ranked, control, data, len(ids)) == ids).all()


def expected(rows, end):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, out = 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_all_documents_in_order(spark, monkeypatch):
    got = token_files.token_output(odd_docs(spark), queries.byte_bpe, 2)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(ODD, 2)
    assert token_files.token_output(no_docs(spark), queries.byte_bpe, 2).collect() == []


def test_added_tokens_in_texts_keep_their_ids(spark):
    rows = [(k, x) for k, x in enumerate(TEXTS)]
    got = token_files.token_output(spark.createDataFrame(rows, "doc_id long, text string"), queries.byte_bpe, 2)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(rows, 2)


def test_ids_come_back(spark):
    files = token_files.write_token_files(odd_docs(spark), shared_folder(spark), queries.byte_bpe, 2)
    rows = token_files.read_token_files(files, with_ids=True).where("doc_id = 1").collect()
    assert rows[0].ids[-1] == 2 and len(rows[0].ids) == rows[0].n_tokens
    assert zlib.crc32(np.array(rows[0].ids, "<u4").tobytes()) == rows[0].ids_crc32


def test_scan_stitches_blocks(spark, tmp_path):
    rng, want = np.random.default_rng(1), []
    for k, n in enumerate((0, 1, 7, 100, 1000, 333)):
        ids = rng.integers(0, 4, n).astype("<u2")
        ids[:50][rng.random(min(50, n)) < 0.8] = 2
        ids.tofile(tmp_path / f"x{k}")
        start = ordinal = 0
        for i in np.flatnonzero(ids == 3):
            want.append((f"x{k}", ordinal, start, i - start, True))
            start, ordinal = i + 1, ordinal + 1
        if start < n:
            want.append((f"x{k}", ordinal, start, n - start, False))
    for block in (2, 64, 4096):
        found = separator_scan.scan(separator_scan.list_files(spark, f"file://{tmp_path}"), 3, block_bytes=block).collect()
        assert sorted((r.path.rsplit("/", 1)[1], *r[1:]) for r in found) == sorted(want)


def test_scan_refuses_broken_file(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"123")
    with pytest.raises(Exception, match="breaks off"):
        separator_scan.scan(separator_scan.list_files(spark, f"file://{tmp_path}"), 3).collect()


def test_count_tokens(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = separator_scan.count_tokens(odd_docs(spark), queries.byte_bpe_multi, queries.CLOSING_ID).collect()
    size = lambda text: len(encoding.encode_ordinary(text or ""))
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((r[0], size(r[1])) for r in ODD), key=str)
    assert all(r.closed for r in got)
    assert separator_scan.count_tokens(no_docs(spark), queries.byte_bpe_multi, queries.CLOSING_ID).count() == 0
