"""The classifier on rows that once went wrong: what must, and what must not, be found."""

import pytest

from admeridian.operators import classifier

SCHEMA = "account_id string, account_name string, website_url string, campaigns string, shopping int, app int, categories map<string,long>, title string, description string"
CASES = {
    "home, not pets": (("Doorwise", "", "Spring 7 / smart lock / generic", 0, 0, {"PURCHASE": 2, "PAGE_VIEW": 3}), {"ecommerce"}, "smart_home"),
    "tutors": (("Quill and Slate Tutors", "", "MCAT tutor - generic - search", 0, 0, {"CONVERTED_LEAD": 2, "BOOK_APPOINTMENT": 1, "PHONE_CALL_LEAD": 2}), {"lead_gen"}, "education_test_prep"),
    "exchange app": (("Kraken North", "", "app_ios_first_deposit bitcoin", 0, 1, {"DOWNLOAD": 3, "PURCHASE": 1}), {"app"}, "fintech_crypto"),
    "cart is no car": (("ZQX", "", "Wave2_AddToCart_Leeds", 0, 0, {"PURCHASE": 1, "DEFAULT": 2, "PHONE_CALL_LEAD": 2}), {"ecommerce", "lead_gen"}, ""),
    "decor": (("Hearthmoss Home Decor", "", "branded shop", 0, 0, {"PHONE_CALL_LEAD": 1, "PAGE_VIEW": 2}), {"ecommerce"}, "home_goods"),
    "country clubs": (("Fernhollow Group", "", "area:FERNHOLLOW COUNTRY CLUB_nr:77_tee time", 0, 0, {"SUBMIT_LEAD_FORM": 4}), {"lead_gen"}, "hospitality_country_club"),
    "collectibles": (("Tin Heron Toys", "", "EU | figures | blended", 0, 1, {"PAGE_VIEW": 2, "DEFAULT": 1}), {"ecommerce"}, "collectibles"),
    "grant": (("Old Mill Museum - Grant", "", "Old Mill visits", 0, 0, {"SIGNUP": 1, "SUBMIT_LEAD_FORM": 1}), {"nonprofit"}, "nonprofit"),
    "nothing": ((None, None, None, None, None, None), {"unknown"}, ""),
    "address": (("Unclear Trading Name", "coinbase-mirror.example", "", 0, 0, {"PURCHASE": 1}), {"app"}, "fintech_crypto"),
    "hyphens": (("Plain Name", "three-oak-partners.example", "", 0, 0, {"BOOK_APPOINTMENT": 1}), {"lead_gen"}, ""),
    "part of an address": (("Plain Name", "northskincare.example", "", 0, 0, {"PURCHASE": 1}), {"ecommerce"}, "beauty"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, *v[0], None, None) for k, v in CASES.items()], SCHEMA)
    return {r.account_id: r for r in classifier.classify(rows).collect()}


@pytest.mark.parametrize("case", sorted(CASES))
def test_case(found, case):
    _, types, vertical = CASES[case]
    assert found[case].business_type in types and found[case].vertical == vertical


def test_trace_and_confidence(found):
    assert any("CAMP[" in x for x in found["home, not pets"].rule_trace) and any("CONV[PURCHASE" in x for x in found["home, not pets"].rule_trace)
    assert any("NAME[" in x for x in found["tutors"].rule_trace)
    assert any("URL[" in x for x in found["address"].rule_trace) and found["nothing"].confidence == 0.0


def test_override_wins(spark):
    rows = spark.createDataFrame([("x", "Kraken North", None, None, None, None, None, None, None)], SCHEMA)
    over = spark.createDataFrame([("x", "saas", "software")], "account_id string, business_type string, vertical string")
    r = classifier.classify(rows, over).first()
    assert (r.business_type, r.vertical, r.confidence, r.rule_trace) == ("saas", "software", 1.0, ["OVERRIDE"])
