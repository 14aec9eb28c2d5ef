from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.sources import readers as R
from tidemark.sources import writers as W


def test_bar_json(spark, tmp_path):
    lines = [
        '{"Time":"20250808 03:30:00 Pacific/Honolulu","Open":1,"High":2,"Low":0.5,"Close":1.5,"Volume":10,"WAP":1.2,"Count":3}',
        '{"Time":"20250808 03:30:00 Pacific/Honolulu","Open":1,"High":2,"Low":0.5,"Close":1.5,"Volume":10,"WAP":1.2,"Count":3}',
        '{"Time":"20250808 09:31:00 Eastern","Open":0,"High":2,"Low":0.5,"Close":1.5,"Volume":-1,"Extra":1}',
        "not json",
        "",
    ]
    (tmp_path / "b.json").write_text("\n".join(lines))
    got = R.bars_json(spark, str(tmp_path / "b.json"), "SPY").collect()
    good = [r for r in got if not r.errors]
    assert len(got) == 3 and [(r.ts, r.open) for r in good] == [(datetime(2025, 8, 8, 9, 30), 1.0)]
    bad = [r for r in got if r.ts == datetime(2025, 8, 8, 9, 31)][0]
    assert bad.errors == ["open not positive"] and bad.volume == 0


def test_daily_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Date,Open,High,Low,Close,Volume\n2025-01-02,1,2,0.5,1.5,x\n2025-01-03,1,2,3,1.5,7\nbad,1,2,1,1,1\n2025-01-06,0,2,1,1,1\n2025-01-07,1,2,1\n")
    got = R.bars_daily_csv(spark, str(tmp_path / "d.csv"), "S").collect()
    assert [(r.ts, r.volume, r.wap) for r in got] == [(datetime(2025, 1, 2), 0.0, 1.5)]


def test_vendor_csv(spark, tmp_path):
    def ns(h, m):
        from datetime import timezone

        return int(datetime(2024, 8, 14, h, m, tzinfo=timezone.utc).timestamp()) * 10**9

    rows = ["ticker,volume,open,close,high,low,window_start,transactions"]
    rows += [f"{t},5,1,2,3,0.5,{ns(h, m)},4" for t, h, m in [("SPY", 13, 30), ("SPY", 20, 15), ("O:SPY240814C00390000", 14, 0), ("O:SPYX240814C00390000", 14, 0), ("QQQ", 14, 0), ("SPY", 13, 29)]]
    (tmp_path / "m.csv").write_text("\n".join(rows))
    got = R.bars_vendor_csv(spark, str(tmp_path / "m.csv"), "SPY").collect()
    assert sorted((r.symbol, r.ts) for r in got) == [("O:SPY240814C00390000", datetime(2024, 8, 14, 10, 0)), ("SPY", datetime(2024, 8, 14, 9, 30))]
    assert R.vendor_path("us_stocks", "2024-08-14") == "us_stocks_v1/2024/08/2024-08-14.csv.gz"


def test_edgar_index(spark, tmp_path):
    text = "Form Type   Company   CIK\n-----------\n4   ACME CORP   12345   2025-08-07   edgar/data/1/0001234567-25-000001.txt\n4   ACME CORP   12345   2025-08-07   edgar/data/2/0001234567-25-000001.txt\n8-K   OTHER   9   2025-08-07   edgar/x.txt\n"
    (tmp_path / "form.idx").write_text(text)
    got = R.edgar_index(spark, str(tmp_path / "form.idx"), day="2025-08-07").collect()
    assert [(r.company, r.accession, r.filing_date) for r in got] == [("ACME CORP", "0001234567-25-000001", date(2025, 8, 7))]


XML = """<ownershipDocument><issuer><issuerTradingSymbol>ACME</issuerTradingSymbol></issuer><aff10b5One>0</aff10b5One>
<reportingOwner><reportingOwnerId><rptOwnerName>Doe</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>true</isOfficer></reportingOwnerRelationship></reportingOwner>
<nonDerivativeTable>{plain}{plain}</nonDerivativeTable><derivativeTable>{derived}</derivativeTable></ownershipDocument>"""
ROW = """<{t}><securityTitle><value>{s}</value></securityTitle><transactionDate><value>2025-08-07</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding>
<transactionAmounts><transactionShares><value>1000</value></transactionShares><transactionPricePerShare><value>300.5</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts></{t}>"""


def test_form4(spark):
    from tidemark.operators import insider

    xml = XML.format(plain=ROW.format(t="nonDerivativeTransaction", s="Common"), derived=ROW.format(t="derivativeTransaction", s="Option"))
    d = R.form4(spark.createDataFrame([("a1", xml)], "accession string, xml string"))
    got = insider.flags(d).collect()
    assert sorted(r.security for r in got) == ["Common", "Common", "[DERIVATIVE] Option"]
    assert all(r.ticker == "ACME" and r.owner == "Doe" and r.is_director and r.is_officer and r.is_open_market for r in got)
    assert insider.signals(d).count() == 2


def test_waves(spark):
    w = [r.value for r in R.triangle_wave(spark, 10, 20, 2, 8).orderBy("i").collect()]
    assert w == [10, 15, 20, 15, 10, 15, 20, 15]
    assert abs(R.sine_wave(spark, 4, 2, 1, 5, 1, 0).orderBy("i").collect()[1].value - 6) < 1e-12


def test_bars_from_closes(spark):
    d = spark.createDataFrame([("S", [10.0, 12.0, 11.0])], "symbol string, closes array<double>")
    got = R.bars_from_closes(d, 5).orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close) for r in got] == [(10, 10, 10, 10), (10, 12, 10, 12), (12, 12, 11, 11)]
    assert got[2].ts == datetime(2024, 1, 1, 0, 10)


def test_sinks(spark, tmp_path):
    b = spark.sql("SELECT 'O:A/B' AS symbol, timestamp_ntz'2025-01-02 09:30:00' AS ts, 1.005D AS open, 2D AS high, 0.5D AS low, 1.125D AS close, 10L AS volume, 1.23456D AS wap, false AS manufactured")
    b = b.unionByName(b.withColumn("ts", F.expr("ts + interval 1 day")))
    W.bars_json(b, str(tmp_path / "j"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert "20250103" in lines[0] and '"Close":1.12' in lines[0] and '"WAP":1.235' in lines[0]
    W.by_contract(b, str(tmp_path / "c"))
    assert [p.name for p in (tmp_path / "c").iterdir() if p.is_dir()] == ["contract=O_A_B"]
    W.daily_guide(b, str(tmp_path / "g"))
    assert spark.read.csv(str(tmp_path / "g"), header=True).count() == 2
    assert W.merged(b, b, ["ts"]).count() == 2
