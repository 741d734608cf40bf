"""What PII detection finds beside the plain forms."""

import pytest

from tributary.llm import pii

CARD = "4111 1111 1111 1111"


def found(text, kind):
    return [text[s:e] for s, e, k in pii.detect(text) if k == kind]


@pytest.mark.parametrize("text", [f"{CARD} 12/27", f"{CARD} 305", f"no 12 {CARD} x", f"{CARD} 1 2 3 4 5 6 7", "17-4111-1111-1111-1111-12/27"])
def test_cards_beside_other_digits(text):
    assert CARD in [c.replace("-", " ") for c in found(text, "card")]


def test_cards_alone_and_none():
    assert found(f"{CARD}, {CARD.replace(' ', '')} and {CARD.replace(' ', '-')}.", "card") == [CARD, CARD.replace(" ", ""), CARD.replace(" ", "-")]
    assert found("1219538112535716 4111 1111 1111 1112 x4111111111111111 4111111111111111-", "card") == []


NAMES = ["Mary McDonald", "Mary O'Brien", "Mary O’Brien", "Anna Wiśniewska", "Maria Smith-Jones", "Jean-Pierre Dupont", "Anna Đặng", "Maria Παπαδοπούλου", "Анна Їжакевич", "Anna Łoś", "Mary Smith"]


@pytest.mark.parametrize("name", NAMES)
def test_names_whole(name):
    text = f"said {name}, and {name}'s house; {name.split()[1]} left"
    assert found(text, "name") == [name, name]
    new, entities = pii.replace(text)
    assert len(entities) == 3 and name not in new and not any(p in new for p in name.split()) and new == pii.replace(text)[0]
    assert new.startswith("said ") and new.endswith(" left")


def test_titles():
    assert found("Mr. Smith said", "name") == ["Smith"]
    assert found("Prof. Dr. Müller and Dr Anna Łoś", "name") == ["Müller", "Anna Łoś"]
    assert found("Frau Meyer-Landrut, Mr. and Mrs. O'Neill", "name") == ["Meyer-Landrut", "O'Neill"]
    new, _ = pii.replace("Mr. Smith and Mary Smith")
    assert new.split()[1] == new.split()[4] != "Smith"
    assert found("The House is Mine. Mary said. mary smith", "name") == []
