"""Readers of filings, holders, posts and people on literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import collectors, dates, filings, holders, proposals, queries, resolver, text, urls
from tessera.functions import discovery as D
from tessera.operators import people


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values) or "z string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], kinds).select(column.alias("x")).first()["x"]


def test_names_and_terms(spark):
    t = F.col("t")
    for name, key in (("Lago Technologies ( https://getlago.com/ )(YCS21)", "lago"), ("[LiveKit]( http://livekit.io/ )", "livekit"), ("Fusemachines Inc.", "fusemachines"), ("Foo & Bar Holdings, Inc.", "fooandbar"), ("Company of Heroes GmbH", "companyofheroesgmbh"), ("广联达 Group", "广联达")):
        assert one(spark, text.company_key(t), t=name) == key
    assert one(spark, queries.salient_terms(t, F.lit("世纪互联")), t="世纪互联最近启动了OCP设计建设") == ["OCP"]
    assert one(spark, queries.correct_terms(t), t="广联达控股x招fde工程师a，不是fde工程师") == "广联达科技股份有限公司x招前置部署工程师a，不是fde工程师"
    assert [c["corrected"] for c in one(spark, queries.term_corrections(t), t="OPC和baidci")] == ["OCP", "AIDC", "AIDC"]
    assert one(spark, text.coverage_text(t), t="Ａ b\n（C）") == "ab(c)"
    assert one(spark, text.truncated_hanzi(t, 2), t="a汉b字c好d") == "a汉b字c…"
    assert one(spark, text.sentence_count(t), t="一。 二！?三") == 3


def test_addresses(spark):
    u = F.col("u")
    assert one(spark, urls.canonical_url(u), u="HTTPS://Example.com?utm_source=a") == "https://example.com/"
    for url, weak in (("https://www.google.com.hk/x", True), ("https://x.org/search?hl=en&q=1", True), ("http://", True), ("https://x.org/?u=/search?q=", False), ("https://x.org/research?q=1", False), ("ftp://x.org", True)):
        assert one(spark, urls.is_weak_source(u), u=url) is weak
    assert one(spark, urls.source_hint(u), u="https://beian.cac.gov.cn/x") == "other"
    for url, why in (("https://x.org/a", None), ("ftp://x.org", "protocol"), ("https://me:pw@x.org/", "credentials"), ("http://localhost/", "internal"), ("http://127.0.0.1/", "internal"), ("http://[::1]/", "internal"), ("nonsense", "unreadable")):
        assert one(spark, urls.fetch_refusal(u), u=url) == why


def test_dates_of_texts(spark):
    t = F.col("t")
    assert one(spark, dates.is_expired(t, "2025-03-01"), t="2020-01-01T10:00:00Z") is True
    assert one(spark, dates.is_expired(t, "2025-03-01"), t="soon") is False
    past = lambda s: str(one(spark, dates.latest_past_date(t, "2025-03-01"), t=s))
    assert past("2024年5月，2023-02-30") == "2024-05-01"
    assert past("2023-02-30 and 2026-01-01") == "2023-03-02"
    assert past("1989-01-01, 2024年5月6日") == "2024-05-06"
    assert one(spark, collectors.official_date(t), t="08/29 2025 x") == "2025-08-29"


def test_labels(spark):
    t = F.col("t")
    got = one(spark, filings.after_label(t, "人数", r"[\d,]+", 20), t="人数 无\n\n人数      1,567 人")
    assert (got["value"], got["quote"]) == ("1,567", "人数 1,567")
    assert one(spark, filings.after_label(t, "人数", r"[\d,]+", 20), t="人数\n\n19,254")["value"] is None  # a blank line ends the row
    long = "人数" + " " * 15 + "1,234,567,890"
    assert one(spark, filings.after_label(t, "人数", r"[\d,]+", 20), t=long)["value"] == "1,234,567,890"  # only the beginning must lie within
    assert one(spark, filings.after_label(t, "人数", r"[\d,]+", 10), t=long)["value"] is None
    box = one(spark, filings.checkbox(t, "变更", "是", "否"), t="变更 □适用☑不适用\n公司报告期控股股东未发生变更。")
    assert box["value"] == "否——公司报告期控股股东未发生变更。"
    assert one(spark, filings.filing_plain(t), t="<style>a</style>x&#65;&#x42;\t y\n\n\n\nz") == "xAB y\n\nz"


def test_report_facts(spark):
    report = "公司实际控制人为 王文京，\n报告期末在职员工的数量合计（人）  16,818\n\n专业构成类别\n技术人员   9,000\n现场实施  1,567\n教育程度\n为技术人员提供 6,166,665\n研发人员数量占比 59.70%\n重大诉讼、仲裁事项\n□适用 ☑不适用\n"
    got = {(f["dimension"], f["key"]): f["value"] for f in one(spark, filings.filing_facts(F.col("t")), t=report)}
    assert got == {
        ("shareholders", "controller"): "王文京",
        ("team", "headcount"): "现场实施 1,567 人 / 全员 16,818 人（年报「专业构成」口径）",
        ("fde", "productization"): "研发人员占全体员工 59.70%（年报口径，用于观察研发/交付人力结构）",
        ("background", "litigation"): "报告期内无重大诉讼、仲裁事项",
    }
    odd = one(spark, filings.filing_facts(F.col("t")), t="在职员工的数量合计 100\n\n专业构成类别 技术人员 5,000 教育程度")
    assert odd[0]["value"].startswith("全员 100 人")  # more technicians than staff can not be
    ten_k = one(spark, filings.filing_facts(F.col("t"), filings.TEN_K_RULES), t="we had growth. As of then, we had 3,936 full-time employees. Legal Proceedings  From time to time")
    assert [(f["key"], f["value"]) for f in ten_k] == [("headcount", "3,936 full-time employees"), ("litigation", "Legal Proceedings From time to time")]


HK = """Contents SUBSTANTIAL SHAREHOLDERS 12
SUBSTANTIAL SHAREHOLDERS
as at 31 December 2025
Name of Shareholder        Nature        Number of shares            Class      Total
New Wisdom(3) (4)          Owner         37,034,191 Domestic         18.62%     7.13%
                           Interest      27,195,592 H                 8.48%     5.23%
Trustee (Note 1)           Trustee      300,000,000                             9.00%
Short Fund                 Owner         11,111,111                             6.00% (S)


(6) footnote with 23,689,267 H Shares and 1.00%
"""


def test_hk_holders(spark):
    got = [(r["name"], r["pct"], r["share_class"]) for r in one(spark, holders.hk_holders(F.col("t")), t=HK)]
    assert got == [("New Wisdom", "7.13", "Domestic Shares"), ("New Wisdom", "5.23", "H Shares"), ("Trustee", "9.00", None)]
    assert one(spark, holders.as_at_date(F.col("t")), t=HK) == "2025-12-31"
    assert one(spark, holders.hk_holders(F.col("t")), t="no table") == []


def test_us_holders(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    rows = [row("Greater than 5% Stockholders", "", ""), row("The Vanguard Group 100 Vanguard Blvd. Malvern, PA 19355 (1)", "63,802,647", "10.4%", "3.2%"), row("Fivespan Partners, LP", "5,000,000", "*"), row("All as a group", "99,999,999", "50%"), row("Directors and Officers", "", ""), row("Jane Roe", "55,555", "1.0%")]
    page = "<p>Beneficial ownership as of April&#160;6, 2026. Class A Common Stock</p><table>" + "".join(rows) + "</table>"
    got = [(r["name"], r["shares"], r["pct"], r["share_class"]) for r in one(spark, holders.us_holders(F.col("t")), t=page)]
    assert got == [("The Vanguard Group", "63,802,647", "10.4", "Class A Common Stock"), ("Fivespan Partners, LP", "5,000,000", None, "Class A Common Stock")]
    small = "<p>each holder of more than 5% of our shares</p><table>" + row("BlackRock, Inc. 50 Hudson Yards New York", "47,931,575", "7.5") + "</table>"
    assert [(r["name"], r["pct"]) for r in one(spark, holders.us_holders(F.col("t")), t=small)] == [("BlackRock, Inc.", "7.5")]
    assert one(spark, holders.us_holders(F.col("t")), t="<table>" + row("x", "1") + "</table>") == []


def test_holder_lists(spark):
    got = one(spark, holders.holder_list(F.col("t")), t="2026-03-31 十大：1. 甲公司（基金）1.8507%；2. 乙 Ltd 3%（H股）。集中度高。口径：总股本。")
    assert got["preamble"] == "2026-03-31 十大" and got["notes"] == "集中度高" and got["basis"] == "口径：总股本"
    assert [(r["name"], r["pct"], r["note"]) for r in got["rows"]] == [("甲公司", "1.8507", "基金"), ("乙 Ltd", "3", "H股")]
    for prose in ("", "甲 5%", "甲 5%；说不清", "甲 5%；乙，丙 3%"):
        assert one(spark, holders.holder_list(F.col("t")), t=prose) is None


def test_posts(spark):
    t = F.col("t")
    assert one(spark, D.passes_role_gate(t), t="Forward Deployment Engineering (AI/ML)") is True
    assert one(spark, D.passes_role_gate(t), t="forward deployment of troops") is False
    assert one(spark, D.signal_class(t, F.lit("")), t="We hire a forward deployed engineer") == "first-person-org"
    assert one(spark, D.signal_class(t, F.lit("")), t="we " + "x " * 90 + "forward deployed engineer") == "org-description"
    assert one(spark, D.decode_post(t), t="a<p>b &amp;lt; &#39;&#x2F;&#65;") == "a\nb &lt; '/A"
    for header, why in (("Acme (acme.io) | NYC", None), ("no pipe", "no pipe"), ("Seeking work | x", "seeker"), ("We are hiring | x", "pitch"), ("Forward Deployed Engineer | x", "role title"), ("x" * 61 + " | y", "too long")):
        assert one(spark, D.post_company(t), t=header)["why"] == why
    got = one(spark, D.filer(t), t="Airship AI Holdings  (AISP, AISPW)  (CIK 0001842566)")
    assert (got["name"], got["ticker"], got["cik"]) == ("Airship AI Holdings", "AISP", "0001842566")


def test_people(spark):
    t = F.col("t")
    alone = lambda s, n="李全": one(spark, people.stands_alone(t, F.lit(n)), t=s)
    assert [alone(s) for s in ("李全在会上", "李全德", "小李全", "李全", "见李全", "李全, x", "(李全)")] == [True, False, False, True, False, True, True]
    assert alone("李全德说", "李全德") is True and alone("王小明明", "王小明") is True
    assert one(spark, people.aliases(t), t="李全（全哥）(Q)") == ["李全", "全哥"]
    who = spark.createDataFrame([(1, "李全（全哥）"), (2, "李全德"), (3, "X")], "p int, n string")
    said = spark.createDataFrame([(7, "李全在会上"), (8, "李全德来了"), (9, "全哥, 李全德"), (10, "")], "s int, t string")
    assert {tuple(r) for r in people.mentions(said, who, "s", "t", "p", "n").collect()} == {(7, 1), (8, 2), (9, 1), (9, 2)}


def test_clues_and_recall(spark):
    got = one(spark, resolver.clues(F.col("t"), F.lit("星河")), t="听说星河在中关村23号楼，做的是工程绘图相关，今年上市")
    kinds = [c["kind"] for c in got]
    assert kinds[:2] == ["name", "address"] and {"business", "listing"} <= set(kinds)
    business = [c["text"] for c in got if c["kind"] == "business"]
    assert not any(a != b and a in b for a in business for b in business)  # of two that hold one another one stays
    assert one(spark, resolver.tokens(F.col("t")), t="OCP 公司 A股") == ["oc", "cp", "p公", "司a", "a股", "ocp"]
    assert one(spark, resolver.name_similarity(F.col("t"), F.lit("星河科技")), t="星河") == 0.96
    index = spark.createDataFrame([(1, ["星河科技有限公司"], "中关村 工程绘图"), (2, ["大地"], "养殖"), (3, ["别家"], "工程绘图")], "id int, names array<string>, text string")
    asked = spark.createDataFrame([(5, "星河科技", [("business", "工程绘图")])], "ask int, name string, clues array<struct<kind: string, text: string>>")
    rows = {r["id"]: (r["score"], r["place"]) for r in resolver.recall(asked, index).collect()}
    business = 2.6 / 2.4
    assert rows == {1: (round(0.96 * 0.55 + min(1, business) * 0.45, 2), 1), 3: (0.45, 2)}


def test_proposals(spark):
    t = F.col("t")
    for name, kind in (("某某基地", "project"), ("某某产业园", "site"), ("某研究院", "legal"), ("某银行大厦", "brand"), ("建设银行", "legal")):
        assert one(spark, proposals.entity_kind(t, F.lit("Brand")), t=name) == kind
    assert one(spark, proposals.entity_kind(t, F.lit("odd")), t="x") == "unknown"
    assert one(spark, proposals.data_basis(t), t="净利润与营收") == "营收 / 净利润（口径以原文为准）"
    assert one(spark, proposals.market_region(t), t="none") == ""


def test_registry_and_search(spark, tmp_path):
    from tessera.sources import tables

    (tmp_path / "r.csv").write_text('企业名称,法定代表人,上市地,股票代码,实际控制人\n"甲, 公司",王一,深交所,002410,李二\n乙,,,,\n')
    names = spark.createDataFrame([("c1", "甲, 公司"), ("c2", "乙"), ("c3", "丙")], "id string, name string")
    got = {r["id"]: r for r in tables.registered(tables.read_registry(spark, str(tmp_path / "r.csv")), names).collect()}
    assert set(got) == {"c1", "c2"} and got["c2"]["person_id"] is None
    assert (got["c1"]["listing"], got["c1"]["controller"], got["c1"]["representative"]) == ("深交所 002410", "李二", "王一") and got["c1"]["position_id"].startswith("position_")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"query": "q", "results": [{"url": "ftp://a", "title": "x"}, {"url": "https://b", "title": "y"}]}')
    assert [(r["title"], r["url"]) for r in tables.read_search(spark, str(tmp_path / "s")).collect()] == [("y", "https://b")]
