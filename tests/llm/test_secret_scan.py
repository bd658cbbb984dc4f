"""The secret scan on values of known places and encodings."""

import base64
import random

import pytest

from stemma.llm import secret_scan


def value(rng, n=40):
    return "".join(rng.choice(secret_scan.ALPHABETS[4]) for _ in range(n))


@pytest.mark.parametrize("form", ["export AWS_SECRET_ACCESS_KEY={} now", "see https://x.example/a?sig={} now", "a_much_longer_name_for_it={}", "X=={} now"])
def test_values_after_an_equals_sign(form):
    for seed in range(20):
        v = value(random.Random(seed))
        text = form.format(v)
        at = text.index(v)
        assert secret_scan.scan(text)[1] == [(at, 3, at + len(v))]


def test_padding_belongs_to_the_value():
    for seed in range(20):
        v = base64.b64encode(random.Random(seed).randbytes(40)).decode()
        assert v.endswith("==")
        text = f"DefaultEndpointsProtocol=https;AccountKey={v};x"
        assert secret_scan.redacted(text, secret_scan.scan(text)[1]) == "DefaultEndpointsProtocol=https;AccountKey=[random];x"


@pytest.mark.parametrize("size", [20, 24, 32, 40])
@pytest.mark.parametrize("alphabet", secret_scan.ALPHABETS)
def test_recall_by_encoding_and_length(alphabet, size):
    rng = random.Random(f"{alphabet}{size}")
    token = lambda: "".join(rng.choice(alphabet) for _ in range(size))
    assert sum(secret_scan.discoveries([token()])[0] for _ in range(400)) >= 0.94 * 400
    words = ["incomprehensibilities", "usr_local_share_documentation"] * 4  # other candidates beside it
    assert sum(secret_scan.discoveries([token(), *words])[0] for _ in range(400)) >= 0.9 * 400


def test_text_is_no_discovery():
    rng = random.Random(7)
    words = "the get element by class name from document user account service request handler factory configuration value maximum total count default token stream abstract".split()
    for join in ("", "_", "-", "/"):
        tokens = [join.join(rng.choice(words) for _ in range(8)) for _ in range(500)]
        assert sum(secret_scan.discoveries([t])[0] for t in tokens if len(t) >= 20) == 0
