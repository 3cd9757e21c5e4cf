"""Every labelled customer and every test customer is scored once."""

from tidemark.plans import learning


def test_every_customer_is_scored(spark, data, duck):
    rows = learning.gbt_oof(spark, data).toPandas()
    buyers = lambda t: {r[0] for r in duck.execute(f"SELECT DISTINCT custid FROM {t} WHERE custid IS NOT NULL").fetchall()}
    labelled = {r.custid for r in learning.folds_of(spark, data).select("custid").collect()}
    assert set(rows.custid[rows.split == "train"]) == labelled & buyers("train_transactions")
    assert set(rows.custid[rows.split == "test"]) == buyers("test_transactions")
    assert not rows.duplicated(["custid", "split"]).any() and rows.score.between(0, 1).all()
