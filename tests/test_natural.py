"""Sentences and what they fill."""

import pytest

from tesserine import Param
from tesserine.plans.natural import SlotFiller, near_words

PARAMS = [
    Param("brand", options=("Brand#11", "Brand#13", "Brand#21")), Param("colour", options=("red", "blue", "dark green", "turquoise")), Param("kinds", options=("novel", "poetry", "travel"), default=()),
    Param("price_weight"), Param("rating_weight"), Param("min_price"), Param("max_price"), Param("size"), Param("limit"), Param("search_text"),
]

SENTENCES = [
    ("top 40 of brand#13, avoid price, size up to 20", {"limit": 40, "brand": "Brand#13", "price_weight": -1.0, "size": 20}),
    ("show 5 red ones", {"limit": 5, "colour": "red"}),
    ("ten results in dark green", {"limit": 10, "colour": "dark green"}),
    ("not red but something with turqoise", {"colour": "turquoise"}),
    ("everything except blue", {}),
    ("price between 10 and 20", {"min_price": 10, "max_price": 20}),
    ("price under 2k", {"max_price": 2000}),
    ("a price over 1,500 please", {"min_price": 1500}),
    ("price from 3 to 7.5", {"min_price": 3, "max_price": 7.5}),
    ("I prefer a high rating, ignore price", {"rating_weight": 1.0, "price_weight": 0.0}),
    ("rating matters, price doesn't matter, regardless of price", {"rating_weight": 1.0, "price_weight": 0.0}),
    ("poetry and travel, no novel", {"kinds": ["poetry", "travel"]}),
    ("sizes of twelve in Brand#21", {"size": 12, "brand": "Brand#21"}),
    ("best 3 novels with a low price", {"limit": 3, "kinds": ["novel"], "price_weight": -1.0}),
    ("first 12 rows, size 7, max price 1 thousand", {"limit": 12, "size": 7, "max_price": 1000}),
    ("", {}),
    ("tell me a story", {}),
]


@pytest.mark.parametrize("sentence,want", SENTENCES)
def test_sentences(sentence, want):
    got = SlotFiller().fill(sentence, PARAMS)
    assert got.pop("search_text") == sentence
    assert got == want


def test_words_a_mistake_apart():
    assert near_words("turqoise", "turquoise") and near_words("price", "prise") and not near_words("red", "rad") and not near_words("brand#11", "brand#13") and not near_words("travel", "trails")
