import pytest

from thermaweave.llm import secrets

RANKS = {"the": 1, "and": 2, "change": 50, "me": 60, "password": 3, "horse": 900, "correct": 700, "battery": 800, "staple": 1000, "forgotten": 5000}


@pytest.mark.parametrize("text, value", [
    ("passphrase is correcthorsebatterystaple ok", "correcthorsebatterystaple"), ("pwd: qzxkvjwpmhtyrb.", "qzxkvjwpmhtyrb"), ("credential: Zqxvkjwpmhty", "Zqxvkjwpmhty"),
    ("pwd: aK9$xQ2", "aK9$xQ2"), ("pwd: aK9$xQ", "aK9$xQ"),
])
def test_cost_decides_on_every_value(text, value):
    assert [(secrets.KINDS[k], text[v:e]) for _, k, e, v in secrets.spans(text, RANKS)] == [("guess", value)] and secrets.hide(text, secrets.spans(text, RANKS)) == text.replace(value, "[SECRET]")


@pytest.mark.parametrize("text", ["my pass is forgotten now", "Credential: Forgotten", "pwd: 482913", "pwd: changeme2020", "pwd: qwertyuiop", "pwd is correcthorse"])
def test_cheap_values_stay(text):
    assert not secrets.spans(text, RANKS)
