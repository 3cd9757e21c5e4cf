"""Repetition decides whatever the words end in; sentences stay sentences when they stand there again."""

import pytest

from tests.llm.test_stuffing import SENTENCES_EN, SENTENCES_KO
from tidemark.llm.stuffing import SENTENCES, measure

REPEATED = [
    "빈티지담요 할인 빈티지러그사은품 빈티지담요 할인 빈티지담요 할인 피오쥬로 선물 빈티지러그사은품 " * 5,
    "미로마루할인 카디건후기. 새벌점 추천, 미로마루할인. 장갑추천, 미로마루할인. 미로마루할인 셔츠 후기. 데몽젤특가, 미로마루할인. 미로마루할인 가방 무료배송. 배낭 후기, 미로마루할인.",
    "피오쥬로 빈티지담요 누리할인 피오마루 모레담요 벨모레할인 쿠벤디로 한결담요 온뫼할인 데몽쥬로 가온담요 미르할인 " * 6,
    "한결점할인 / 벨트 선물 / 린넨베개 세일 / 한결점할인 / 한결점할인 / 벨트 선물 / " * 6,
]


@pytest.mark.parametrize("text", REPEATED)
def test_repeated_words_bind_nothing(text):
    assert measure([text]).sentence_share[0] < 0.2


@pytest.mark.parametrize("text", [SENTENCES_KO * 30, SENTENCES_EN * 30, "잘 받았습니다. " * 10])
def test_repeated_sentences_are_sentences(text):
    assert measure([text]).sentence_share[0] > SENTENCES
