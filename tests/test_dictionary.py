import random

import pytest

from stringloom.config import Config, MaxDictBits, Threshold
from stringloom.errors import Defect, InvalidArg, InvalidColumn
from stringloom.functions.dictionary import EMPTY_RANGE, Dictionary, code_bits

SINGLES = [bytes([b]) for b in range(256)]


def naive(tokens, text):
    index, out, at = {t: i for i, t in enumerate(tokens)}, [], 0
    while at < len(text):
        n = max(n for n in range(1, 17) if text[at : at + n] in index and at + n <= len(text))
        out.append(index[text[at : at + n]])
        at += n
    return out


def test_tied_keys_and_lookups():
    d = Dictionary.of([b"ab", b"ab\0", b"ab\0\0x", b"a\0", b"\xff" * 16, b"\xff\xff"])
    assert d.sorted and d.complete and d.num_tokens == 262
    for prefix in (b"", b"a", b"ab", b"ab\0", b"\xff", b"\xff" * 16, b"\xff" * 17, b"zz"):
        r = d.prefix_range(prefix)
        want = [i for i, t in enumerate(d.tokens) if t.startswith(prefix)]
        assert (r == EMPTY_RANGE) if not want else (r.begin, r.last, len(r)) == (want[0], want[-1], len(want))
    r = d.prefix_range(b"a")
    assert d.narrow(r, 1, ord("b")) == d.prefix_range(b"ab")
    assert d.longest_prefix(b"ab\0\0")[0] == d.tokens.index(b"ab\0")


def test_tokenize_is_greedy():
    rng = random.Random(1)
    for _ in range(150):
        extra = {bytes(rng.choice(b"abc\0\xff") for _ in range(rng.randint(2, 16))) for _ in range(20)}
        d = Dictionary.of(extra)
        text = bytes(rng.choice(b"abc\0\xff") for _ in range(rng.randint(0, 90)))
        codes = d.tokenize(text)
        assert codes == naive(d.tokens, text)
        assert b"".join(map(d.token, codes)) == text


@pytest.mark.parametrize(
    ("data", "offsets", "defect"),
    [
        (b"", [0], Defect.EMPTY_DICTIONARY),
        (b"a" * 40, [1, 2], Defect.FIRST_OFFSET_NOT_ZERO),
        (b"a" * 40, [0, 2, 1], Defect.DECREASING_OFFSETS),
        (b"a" * 40, [0, 1, 1], Defect.EMPTY_TOKEN),
        (b"a" * 60, [0, 20], Defect.TOKEN_TOO_LARGE),
        (b"ab", [0, 1, 2], Defect.MISSING_PADDING),
        (b"ba" + bytes(20), [0, 1, 2], Defect.UNSORTED_TOKENS),
        (b"ab" + bytes(20), [0, 1, 2], Defect.INCOMPLETE_ALPHABET),
        (b"aa" + bytes(20), [0, 1, 2], Defect.UNSORTED_TOKENS),
    ],
)
def test_malformed(data, offsets, defect):
    with pytest.raises(InvalidColumn) as e:
        Dictionary.from_buffers(data, offsets)
    assert e.value.defect is defect


def test_buffers_round_trip_and_size_limit():
    full = sorted([*SINGLES, *(b"\xff" + i.to_bytes(2, "big") for i in range(65536 - 256))])
    d = Dictionary(full)
    assert Dictionary.from_buffers(d.padded, d.offsets) == d
    assert d.code_bits == 16 and len(d.padded) >= d.offsets[-2] + 16
    with pytest.raises(InvalidColumn):
        Dictionary(sorted([*full, b"\xfe\xfe\xfe"]))
    unsorted = Dictionary.from_buffers(b"ba" + bytes(20), [0, 1, 2], "safety")
    assert unsorted.tokens == (b"b", b"a")


def test_code_bits():
    assert [code_bits(n) for n in (1, 2, 3, 256, 257, 65536)] == [1, 1, 2, 8, 9, 16]


def test_config():
    for bad in (8, 17, 9.5):
        with pytest.raises(InvalidArg):
            MaxDictBits(bad)
    for bad in (0, -1, 1.5):
        with pytest.raises(InvalidArg):
            Threshold(bad)
    assert Config().max_dict_bits.value == 12 and Config().threshold.value == 0.15 and Config().seed == 42
