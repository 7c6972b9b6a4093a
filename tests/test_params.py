import pytest

from tidegrid.errors import InvalidFields, InvalidParams, InvalidTime
from tidegrid.functions.paths import checked_pattern
from tidegrid.functions.timeaxis import ns_range
from tidegrid.params import Params, parse_duration

R, D = 60 * 10**9, 3600 * 10**9
P0 = Params.of("1h", "1m", "10h", 2, 2)


@pytest.mark.parametrize(
    ("text", "ns"),
    [("1h", D), ("1h30m", 90 * R), ("-1.5s", -1_500_000_000), ("+2us", 2000), ("2µs", 2000), ("2μs", 2000), ("0", 0), ("-0", 0), ("1.s", 10**9), (".5ms", 500_000), ("100ns", 100), ("1h1ns", D + 1)],
)
def test_durations(text, ns):
    assert parse_duration(text) == ns


@pytest.mark.parametrize("text", ["", "1", "h", "1d", "1 h", "1h ", "--1h", "1.2.3s", ".s", "+", "300y", "9999999999h", None, 5])
def test_bad_durations(text):
    with pytest.raises(InvalidParams):
        parse_duration(text)


def test_params():
    assert P0.points == 60
    assert Params.from_json(P0.to_json()) == P0
    assert Params.of("1h", "1h", "1h").points == 1
    for bad in (("1h", "31m", "24h"), ("1h", "1m", "90m"), ("0", "1m", "24h"), ("-1h", "-1m", "-24h")):
        with pytest.raises(InvalidParams):
            Params.of(*bad)
    with pytest.raises(InvalidParams):
        Params.of("1h", "1m", "24h", 0, 1)
    for text in ("", "{}", "[]", '{"duration": "1h"}', '{"duration": 5, "resolution": "1m", "retention": "1h", "maxROEpochs": 1, "maxRWEpochs": 1}'):
        with pytest.raises(InvalidParams):
            Params.from_json(text)


@pytest.mark.parametrize(("start", "end"), [(5 * R, 4 * R), (0, 0), (0, R - 1), (-1, R), (0, 1 << 63)])
def test_no_range(start, end):
    with pytest.raises(InvalidTime):
        ns_range(start, end, P0)


@pytest.mark.parametrize(("start", "end"), [(R + 1, R + 1), (R + 1, R + 2), (D, D), (D + 5, D + 6)])
def test_empty_range(start, end):
    assert ns_range(start, end, P0).empty


def test_ranges():
    r = ns_range(0, D, P0)
    assert (r.lo, r.hi, r.first_epoch, r.last_epoch) == (0, D, 0, 0)
    r = ns_range(D - R + 7, D + R + 9, P0)
    assert (r.lo, r.hi, r.first_epoch, r.last_epoch) == (D - R, D + R, 0, D)
    r = ns_range(5, 3 * D, Params.of("1h", "1h", "1h"))
    assert (r.lo, r.hi, r.first_epoch, r.last_epoch) == (0, 3 * D, 0, 2 * D)


def test_patterns():
    assert checked_pattern(("a", "*")) == ["a", "*"]
    for bad in ([], ["a", ""], "a", [None], None):
        with pytest.raises(InvalidFields):
            checked_pattern(bad)
