"""Secret scans: any text goes through, and every wrapping of every encoder is found."""

import base64
import bz2
import gzip
import lzma
import random
import time
import zlib

import pytest
import zstandard

from quarry.llm.secret_scan import redacted, secrets, spans

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
MARKS = ["eJ", "eAE", "eNo", "KLUv", "H4sI", "QlpoO", "/Td6WFoA", "A", "b", "==", "\n" + "A" * 16, "%41", "\\u0041", "\0", " "]
ENCODERS = {
    "plain": lambda b: b,
    "gzip": gzip.compress,
    "zlib": zlib.compress,
    "bzip2": bz2.compress,
    "xz": lzma.compress,
    "zstd": lambda b: zstandard.ZstdCompressor().compress(b),
    "members": lambda b: gzip.compress(b[:5]) + gzip.compress(b[5:]),
    "twice": lambda b: gzip.compress(bz2.compress(b)),
    "utf-16-le": lambda b: b.decode().encode("utf-16-le"),
    "utf-16": lambda b: b.decode().encode("utf-16"),
}


def test_random_runs_never_raise():
    rnd = random.Random(3)
    for _ in range(100_000):
        spans("".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(14, 40))))
    for _ in range(5_000):
        spans("".join(rnd.choice(MARKS) for _ in range(rnd.randrange(2, 30))))


@pytest.mark.parametrize("name", ENCODERS)
def test_glued_and_wrapped_runs_of_every_length(name):
    rnd = random.Random(4)
    for length in range(12, 70):
        secret = b"token=" + "".join(rnd.choice("ghijklmnop") for _ in range(length - 6)).encode()
        run = base64.b64encode(ENCODERS[name](secret)).decode()
        for glue in ("", "x", "x/", "abc", "abcd+"):
            whole = glue + run
            for wide in (0, 20, 64):
                text = "\n".join(whole[k : k + wide] for k in range(0, len(whole), wide)) if wide else whole
                found = [(s, e) for s, kind, e in spans(f"see {text} there")[1] if kind == 0]
                assert found, (name, length, glue, wide)
                assert all(4 <= s < e <= 4 + len(text) for s, e in found)
                assert run.rstrip("=")[-6:] not in redacted(f"see {text} there")


def test_members_that_begin_at_the_end_of_a_chunk():
    for tail in range(1, 8):
        first = gzip.compress(random.Random(tail).randbytes(256 * 3 // 4 - 30 - tail), 0)
        run = base64.b64encode(first + gzip.compress(b"password=hunter2222")).decode()
        assert any(kind == 0 for _, kind, _ in spans("ab" + run)[1]), tail


def test_joined_lines_are_scanned_for_what_they_encode_alone():
    text = "0123456789abcdef0123\n0123456789abcdef0123\n"
    assert spans(text) == ([], [])


def test_many_marks_take_linear_time():
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        spans("eJw" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * max(took[0], 0.05)


def test_empty_tables_nulls_and_other_columns(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "see https://example.org/a/veryLongPathSegmenteJ for more", "c")], "doc_id long, text string, spans string")
    assert [(r.doc_id, r.n_assign, r.spans) for r in secrets(docs).orderBy("doc_id").collect()] == [(None, 0, ""), (1, 0, ""), (2, 0, "")]
    assert secrets(docs.limit(0)).collect() == []
