import datetime as dt
import tempfile


from ledgerlens.sources import LINE_SCHEMA, read_lines_csv


def test_csv_scan_with_messy_header_and_bad_values(spark):
    d = tempfile.mkdtemp(prefix="ledgerlens-csv-")
    path = f"{d}/lines.csv"
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("Order ID,Customer ID,Customer Type,Product,Category,Region,Order Date,UnitPrice,Quantity,Discount,Total Price\n")
        fh.write("1,c1,B2B,Moët,wine,Bayern,2023-01-05,10.5,2,0.1,18.9\n")
        fh.write("2,c2,,Tea,soft,,2023-02-01,oops,1,0,3\n")
    df = read_lines_csv(spark, path)
    assert df.columns == [f.name for f in LINE_SCHEMA.fields]
    rows = {r["order_id"]: r for r in df.collect()}
    assert rows["1"]["product"] == "Moët" and rows["1"]["order_date"] == dt.date(2023, 1, 5)
    assert rows["1"]["unit_price"] == 10.5
    assert rows["2"]["unit_price"] is None  # malformed number -> null
    assert rows["2"]["customer_type"] is None  # empty unquoted field -> null
