"""Spans of private keys hold the key, not its header only."""

import base64
import random

import pytest

from tallyspring.llm import secrets

RULES = (*secrets.BASE, *secrets.MORE)
BODY = base64.b64encode(random.Random(1).randbytes(610)).decode()
LINES = [BODY[i : i + 64] for i in range(0, len(BODY), 64)]
HEAD, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def shown(text):
    return secrets.redacted(text, secrets.Scanner(RULES).spans([text])[0], [r.kind for r in RULES])


@pytest.mark.parametrize(
    "key",
    [
        "\n".join([HEAD, *LINES, END]),
        "\r\n".join([HEAD, *LINES, END]),
        "\\n".join([HEAD, *LINES, END]),
        "\n".join([HEAD, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,AB12", "", *LINES, END]),
        " ".join([HEAD, *LINES, END]),
        "\n".join(["-----BEGIN PRIVATE KEY-----", *LINES, "-----END PRIVATE KEY-----"]),
        "\n".join([HEAD, *LINES]),
        "\n".join([HEAD, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,AB12", "", *LINES]),
        "\\n".join([HEAD, *LINES]),
        HEAD + "\n" + LINES[0][:7],
        HEAD,
    ],
)
def test_a_key_goes_whole(key):
    assert shown(f"before\n{key}\n\nand more text after it") == "before\n[key]\n\nand more text after it"
    assert shown(f"{key}\n{key}") == "[key]\n[key]"


def test_a_key_ends_where_it_ends():
    assert shown(f"A line {HEAD} begins a key.") == "A line [key] begins a key."
    cut = "\n".join([HEAD, *LINES])
    assert shown(f"{cut}\nsome words between\n{cut}\n{END}") == "[key]\nsome words between\n[key]"
    assert shown(f"{cut}\n-----END OTHER-----") == "[key]\n-----END OTHER-----"


def test_queries_of_keys_lose_nothing():
    assert secrets.trigram_query(secrets.KEY) == secrets.trigram_query(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
