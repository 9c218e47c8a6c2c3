"""Sentences that must fail, must not fail, or must only be reported."""

import pytest

from prosewell.operators import claims

MUST_FAIL = ("「さくら」は四文字だ。", "「がっこう」は三拍だ。", "四文字の言葉「うみ」を書いた。", "「つばめ」は三文字ではなく、五文字だ。", "「ひまわり」は２文字です。")
MUST_NOT = (
    "「さくら」は三文字だ。", "「がっこう」は四拍だ。", "三文字の名前「さくら」を呼んだ。", "「つばめ」は五文字ではなく、三文字だ。", "もし「さくら」は四文字なら困る。", "「さくら」は四文字だ。いや、三文字だ。",
    "「漢字」は三拍だ。", "題名は五文字だ。", "「うみ、そら」は四文字だ。", "「うみ、そら」は五文字だ。", "数え直すと「さくら」は四文字だった。", "三文字と言われた。",
)
MUST_REPORT = ("「さくら」は四文字かもしれない。", "「さくら」は四文字だろうか。", "カレンダーは四文字だ。", "「あの「さくら」は四文字だよ」")


@pytest.fixture(scope="module")
def judged(spark):
    rows = list(enumerate(MUST_FAIL + MUST_NOT + MUST_REPORT))
    found = claims.count_claims(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {text: {r["severity"] for r in found if r["doc_id"] == k} - {None} for k, text in rows}


def test_claims_by_their_context(judged):
    assert {t for t in MUST_FAIL if "FAIL" not in judged[t]} == set()
    assert {t for t in MUST_NOT if judged[t]} == set()
    assert {t for t in MUST_REPORT if judged[t] != {"WARN"}} == set()
