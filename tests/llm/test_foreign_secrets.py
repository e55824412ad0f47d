"""Secrets and ordinary tokens of other makes than those the models are taught with."""

import base64
import json
import random
import string

import pytest

from tripwise.llm import secrets

WORDS = "river stone market account session handler config buffer window update parser module street garden message customer".split()
N = 150


def made(rng):
    """Values by kind; the first four kinds are secrets."""
    url64 = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    signs = string.ascii_letters + string.digits
    drawn = lambda k: "".join(rng.choices(signs, k=k))
    words = lambda k: rng.choices(WORDS, k=k)
    return {
        "signed": lambda: ".".join([url64(json.dumps({"alg": "HS256"}).encode()), url64(json.dumps({"sub": rng.randrange(10**9)}).encode()), url64(rng.randbytes(32))]),
        "base64": lambda: base64.b64encode(rng.randbytes(rng.randrange(24, 49))).decode(),
        "prefixed": lambda: rng.choice(["sk_live_", "xoxb-"]) + drawn(30),
        "separated": lambda: "-".join(drawn(8) for _ in range(4)),
        "path": lambda: "/" + "/".join(words(5)),
        "snake": lambda: "_".join(words(4)),
        "kebab": lambda: "-".join(words(4)),
        "camel": lambda: "".join(w.title() for w in words(4)),
    }


def test_foreign_secrets_and_paths(spark, make_docs):
    rng = random.Random(11)
    prose = [(k, " ".join(rng.choices(WORDS + "the of and over under with from".split(), k=40)) + f" secret={base64.b64encode(rng.randbytes(18)).decode()}") for k in range(600)]
    table = secrets.fitted(secrets.labelled_samples(secrets.located(make_docs(prose))))
    kinds = made(rng)
    rows = [(n * N + k, f"see {make()} there") for n, make in enumerate(kinds.values()) for k in range(N)]
    said = [0] * len(kinds)
    for r in secrets.scan(make_docs(rows), table).selectExpr("doc_id", "size(spans) > 0 AS said").collect():
        said[r.doc_id // N] += r.said
    share = dict(zip(kinds, [n / N for n in said], strict=True))
    assert min(list(share.values())[:4]) > 0.95, share
    assert max(list(share.values())[4:]) < 0.1, share


@pytest.mark.parametrize("text", ["", "two words", "one two three four"])
def test_names_of_texts_that_have_few_words(spark, make_docs, text):
    """Texts without three long words give no sample of an identifier."""
    got = secrets.labelled_samples(secrets.located(make_docs([(k, text) for k in range(12)])), n_drawn=0)
    assert got.count() == 0
