import pytest

from promptscore import Options
from promptscore.options import duration_ms


def test_defaults():
    o = Options()
    assert (o.pool_size, o.claim_size, o.max_attempts) == (8, 8, 5)
    assert (o.base_backoff_ms, o.max_backoff_ms, o.poll_interval_ms) == (250, 30_000, 500)
    assert o.max_body_bytes == 82_968_576


@pytest.mark.parametrize(
    "text, ms",
    [("250ms", 250), ("30s", 30_000), ("1m30s", 90_000), ("1.5h", 5_400_000), ("0", 0), ("-2s", -2000), ("1500us", 1)],
)
def test_durations(text, ms):
    assert duration_ms(text) == ms


@pytest.mark.parametrize("text", ["", "5", "ms", "1x", "1 s"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        duration_ms(text)


def test_sections_override_only_given_keys():
    o = Options.from_sections({"retry": {"max_backoff": "1m", "max_attempts": 3}, "worker": {"pool_size": 2}, "mock": None})
    assert (o.max_backoff_ms, o.max_attempts, o.pool_size, o.base_backoff_ms) == (60_000, 3, 2, 250)


@pytest.mark.parametrize("field", ["pool_size", "claim_size", "max_attempts", "max_batch_size"])
def test_limits_must_be_positive(field):
    with pytest.raises(ValueError):
        Options(**{field: 0})
