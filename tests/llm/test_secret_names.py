"""Secrets in NAME=value text."""

import random

import pytest

from loggrove.llm import secrets

rng = random.Random(11)
KEY = "".join(rng.choice("GHJKLMNPQRSTUVWXYZghijkmnopqrstuvwxyz0123456789") for _ in range(40))


@pytest.mark.parametrize("name", ["private_key", "SESSION_KEY", "signature", "pwd", "passphrase", "client_id", "KEY", "credential", "Authorization", "bearer", "passw", "secret_id", "token_2", "api-key-1", "opt=private"])
def test_unquoted_name_and_value(name):
    for before in ("", "export ", "a=1&", "one\n"):
        for padding in ("", "=="):
            text = f"{before}{name}={KEY}{padding} and more"
            start = len(before) + len(name) + 1
            assert list(secrets.candidates(text, secrets.base_spans(text))) == [(start, start + len(KEY) + len(padding))]
            assert secrets.Novelty(b"").of(text, start, start + len(KEY)) >= secrets.NOVELTY


def test_values_without_a_sensitive_name_and_short_ones():
    assert list(secrets.candidates(f"colour={KEY} private", [])) == []
    assert list(secrets.candidates("bearer name_1=abc12345678", [])) == [(7, 25)]  # the whole run, where the value is short
    assert list(secrets.candidates(f"private {KEY}={KEY[::-1]}", [])) == [(8, 48), (49, 89)]
