import pytest

from tidemark.llm.stuffing import keyword_pages, measure

SENTENCES_KO = "가격은 36,400원이었고 온라인에서 본 러그와 17,500원쯤 차이가 났다. 직원이 환불 절차를 3번이나 설명해 줘서 그나마 덜 답답했다. "
SENTENCES_EN = "The whole team told the same thing on Monday morning, and it may have been the crowd since we came early. "
SPAM = [
    "러그 세일 > 담요 특가 > 로퍼 최저가 > 머그컵 할인 > 쿠키 정품 > 비누 추천 > 캐리어 인기 > 벨트 세일 > 우산 특가 > 장갑 정품",
    "#러그세일 #담요특가 #로퍼최저가 #머그컵할인 #쿠키정품 #비누추천 #캐리어인기 #벨트세일",
    "러그세일담요특가로퍼최저가머그컵할인쿠키정품비누추천캐리어인기벨트세일우산특가장갑정품러그할인담요정품로퍼추천머그컵인기쿠키세일비누특가캐리어할인벨트정품",
    "http://a.example/x http://b.example/y https://c.example/z http://d.example/w",
    "<li><a href=\"http://a.example/x\">rug sale</a></li> <li><a href=\"http://b.example/y\">mug coupon</a></li> " * 5,
    "rug cheap blanket coupon loafer sale mug outlet cookie discount soap review suitcase online belt cheap umbrella coupon",
    "코트 베이지 장갑 와인색 셔츠 " * 40,
    "Nollanth 세일 / 벨모레 특가 / Nollanth 세일 / 벨모레 특가 / Nollanth 세일 / 벨모레 특가 / " * 6,
    "Brand|mug|beige|310,700 Brand|glove|cream|330,100 " * 12,
]
PLAIN = [
    SENTENCES_KO * 3, SENTENCES_EN * 3, (SENTENCES_KO * 3).replace(".", ""), (SENTENCES_KO * 2).replace(".", "ㅎㅎ"), "Arrived today.", "ㅋㅋㅋㅋㅋ", "잘 받았습니다.", "good good good!!",
    SENTENCES_KO * 4 + "\n- 러그 세일\n- 담요 특가\nhttp://a.example/x", (SENTENCES_KO * 3).replace(" ", ""),
]


@pytest.mark.parametrize("text", SPAM)
def test_keyword_pages(spark, text):
    assert measure([text]).sentence_share[0] < 0.2
    assert measure([SENTENCES_KO[:40] + " " + text * 3]).sentence_share[0] < 0.42


@pytest.mark.parametrize("text", PLAIN)
def test_sentences(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert not keyword_pages(df, "doc_id", "text").first().is_stuffed


def test_rows_of_every_kind(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "?!…"), (5, SPAM[0]), (6, SPAM[0]), (7, (SPAM[0] + " ") * 3000), (8, SENTENCES_EN * 3000)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, k string, t string")
    got = {r.doc_id: (r.is_stuffed, r.n_terms) for r in keyword_pages(df, "doc_id", "text").collect()}
    assert {i for i, (s, _) in got.items() if s} == {5, 6, 7}
    assert all(got[i][1] == 0 for i in (1, 2, 3, 4)) and got[7][1] == 3000 * got[5][1]
    assert keyword_pages(df.where("false"), "doc_id", "text").count() == 0


def test_texts_do_not_touch_each_other():
    many = measure([SENTENCES_KO, SPAM[0], "", SENTENCES_EN, SPAM[6]])
    for k, t in enumerate([SENTENCES_KO, SPAM[0], "", SENTENCES_EN, SPAM[6]]):
        assert measure([t]).iloc[0].to_dict() == many.iloc[k].to_dict()


def test_the_lag_of_a_repeated_list_is_found():
    r = measure(["코트 베이지 장갑 와인색 셔츠 " * 40]).iloc[0]
    assert r.best_lag % 5 == 0 and r.autocorrelation > 0.99 and r.repeated_share > 0.9


OTHER = [
    "Der Teppich ist sehr weich und die Farbe passt gut zu unserem Sofa. Die Lieferung kam nach zwei Tagen und der Karton war leider etwas beschädigt, aber der Kundendienst hat schnell geholfen.",
    "La alfombra es muy suave y el color combina bien con nuestro sofá. El envío llegó en dos días y la caja estaba algo dañada, pero el servicio al cliente nos ayudó rápido.",
    "Le tapis est très doux et la couleur va bien avec notre canapé. La livraison est arrivée en deux jours mais le carton était un peu abîmé.",
    "Matto on erittäin pehmeä ja väri sopii hyvin sohvaamme. Toimitus saapui kahdessa päivässä, mutta laatikko oli hieman vaurioitunut.",
    "このラグはとても柔らかくて、色もソファによく合います。配送は二日で届きましたが、箱が少し傷んでいました。カスタマーサービスがすぐに対応してくれました。",
    "这块地毯非常柔软，颜色也很适合我们的沙发。快递两天就到了，不过箱子有点破损，客服很快就帮我们解决了。",
    "Ковёр очень мягкий, и цвет хорошо подходит к нашему дивану. Доставка пришла через два дня, но коробка была немного повреждена.",
]


@pytest.mark.parametrize("text", OTHER)
def test_prose_of_other_languages(text):
    assert measure([text, text * 20]).sentence_share.min() > 0.67


@pytest.mark.parametrize("text", ["러그 세일 담요 특가 로퍼", "rug sale blanket cheap loafer", "Teppich günstig Sofa Angebot Schuhe Rabatt Tasche Gutschein Lampe billig", "ラグ セール コート 特価 ブランケット 激安 マグカップ"])
def test_short_lists(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert keyword_pages(df, "doc_id", "text").first().is_stuffed


def test_periods_of_any_length():
    r = measure([" ".join(f"상품{i}쥬로 누리{i}고" for i in range(45)) * 3]).iloc[0]
    assert r.best_lag == 89 or r.best_lag == 90
    assert r.sentence_share < 0.2
