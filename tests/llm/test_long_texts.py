"""Texts of one to two megabytes that are unlike prose, under bounds of time and memory."""

import random
import time
import tracemalloc

import public_tokenizers
import pytest
import regex
import sentencepiece

from ledgersieve.llm import divergence, packing, pieces, pii, secret_scan, warc

RND = random.Random(7)
LONG = {
    "blanks": " " * 1_500_000,
    "one letter": "a" * 1_500_000,
    "no blanks": "".join(chr(0x4E00 + RND.randrange(3000)) for _ in range(400_000)),
    "escaped json": '\\"a\\":1,' * 150_000,
    "quotes": "'" * 300_000 + '"x' * 300_000,
    "spans": "a@b.co 10.0.0.1 +1 23456789012 password=abcdef12 " * 25_000,
    "lines": "\n" * 1_000_000,
}


def bounded(work, seconds, megabytes):
    tracemalloc.start()
    began = time.time()
    try:
        return work()
    finally:
        took, peak = time.time() - began, tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert took < seconds and peak < megabytes, (took, peak)


@pytest.mark.parametrize("name", LONG)
def test_lexer(name):
    bounded(lambda: secret_scan.spans(LONG[name]), 40, 1200)


@pytest.mark.parametrize("name", LONG)
def test_packing_and_counts(name):
    coder, _ = packing.encoder(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    ids = bounded(lambda: packing.encoded(coder, LONG[name]), 40, 400)
    assert coder.decode(ids) == LONG[name]
    bounded(lambda: divergence.count_terms(LONG[name].encode()), 20, 400)
    body = LONG[name].encode()
    record = b"WARC-Type: response\r\nWARC-Date: d\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" % (
        len(body) + 19) + body
    assert bounded(lambda: warc.parse_record(record), 20, 100)[6] == len(body)


@pytest.mark.parametrize("name", [n for n in LONG if n != "lines"])
def test_pieces(name):
    model = public_tokenizers.path("piece_bpe_32k.model")
    coder = pieces.PieceCoder(open(model, "rb").read())
    ids, = bounded(lambda: coder.encode([LONG[name]]), 120, 600)
    short = LONG[name][:20_000]
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    assert coder.encode([short])[0].tolist() == library.encode(short)
    assert len(ids)


def test_runs_of_blanks_are_cut_like_the_pattern_does():
    coder, _ = packing.encoder(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    for run in (" " * 2500, "\t" * 2500, " \n" * 1500, "　" * 2100, " " * 1999):
        for text in (run, "a" + run, run + "b", "a" + run + "b c", run + "\n" + run + "!", "1" + run + "'s"):
            whole = [i for token in regex.findall(packing.PRE_TOKEN, text)
                     for i in coder._encode_single_piece(token)]
            assert packing.encoded(coder, text) == whole


def test_escaped_quotes_begin_no_string():
    found = secret_scan.spans('{\\"db_password\\":\\"aB3dE5gH7jK9mN1p\\"} it\'s key = "aB3dE5gH7jK9mN1pQ"')
    assert [s[0] for s in found].count("literal") >= 1
