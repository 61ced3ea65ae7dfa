import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemill.plans import synth

# The declared schemas of the sales tables.
SCHEMAS = {
    "Address": "AddressId int, AddressLine1 string, AddressLine2 string, City string, StateProvince string, CountryRegion string, PostalCode string, rowguid string, ModifiedDate timestamp",
    "Customer": "CustomerId int, NameStyle boolean, Title string, FirstName string, MiddleName string, LastName string, Suffix string, CompanyName string, SalesPerson string, EmailAddress string, Phone string, PasswordHash string, PasswordSalt string, rowguid string, ModifiedDate timestamp",
    "CustomerAddress": "CustomerId int, AddressId int, AddressType string, rowguid string, ModifiedDate timestamp",
    "Product": "ProductId int, Name string, ProductNumber string, Color string, StandardCost decimal(19,4), ListPrice decimal(19,4), Size string, Weight decimal(8,2), ProductCategoryId int, ProductModelId int, ModifiedDate timestamp, SellStartDate timestamp, SellEndDate timestamp, DiscontinuedDate timestamp, ThumbNailPhoto binary, ThumbnailPhotoFileName string, rowguid string",
    "ProductCategory": "ProductCategoryID int, ParentProductCategoryID int, Name string, rowguid string, ModifiedDate timestamp",
    "ProductDescription": "ProductDescriptionID int, Description string, rowguid string, ModifiedDate timestamp",
    "ProductModel": "ProductModelID int, Name string, CatalogDescription string, rowguid string, ModifiedDate timestamp",
    "ProductModelProductDescription": "ProductModelID int, ProductDescriptionID int, Culture string, rowguid string, ModifiedDate timestamp",
    "SalesOrderHeader": "SalesOrderID int, RevisionNumber int, ModifiedDate timestamp, OrderDate timestamp, DueDate timestamp, ShipDate timestamp, Status int, OnlineOrderFlag boolean, SalesOrderNumber string, PurchaseOrderNumber string, AccountNumber string, CustomerID int, ShipToAddressID int, BillToAddressID int, ShipMethod string, CreditCardApprovalCode string, SubTotal decimal(19,4), TaxAmt decimal(19,4), Freight decimal(19,4), TotalDue decimal(19,4), Comment string, rowguid string",
    "SalesOrderDetail": "SalesOrderID int, SalesOrderDetailID int, OrderQty int, ProductID int, UnitPrice decimal(19,4), UnitPriceDiscount decimal(19,4), LineTotal decimal(38,6), rowguid string, ModifiedDate timestamp",
}


@pytest.mark.parametrize("table", SCHEMAS)
def test_schema_and_size(spark, table):
    frame = synth.generate(spark, table)
    assert frame.dtypes == spark.createDataFrame([], SCHEMAS[table]).dtypes
    assert frame.count() == synth.ROWS[table]
    assert frame.select("rowguid").distinct().count() == synth.ROWS[table]


def test_same_rows_at_any_partitioning_and_other_rows_for_another_seed(spark):
    one = synth.generate_from(spark.range(50).repartition(1), "Product", 3)
    many = synth.generate_from(spark.range(0, 50, 1, 7), "Product", 3)
    other = synth.generate(spark, "Product", 50, 4)
    assert rows(one) == rows(many)
    assert not set(rows(one, "rowguid")) & set(rows(other, "rowguid"))


def test_product_rules(spark):
    wrong = synth.generate(spark, "Product", 2000).where(
        ~(
            F.col("Name").endswith(F.concat(F.lit(" - "), "Color", F.lit(","), "Size"))
            & F.col("Size").isin("S", "M", "L", "XL")
            & F.col("ProductCategoryId").between(9000, 9100)
            & F.col("ProductModelId").between(4000, 4150)
            & (F.col("SellStartDate") == F.col("ModifiedDate") - F.expr("interval 10 days"))
            & (F.col("SellEndDate") == F.col("ModifiedDate") - F.expr("interval 5 days"))
            & (F.col("DiscontinuedDate") == F.col("SellEndDate") + F.expr("interval 1 day"))
            & (F.octet_length("ThumbNailPhoto") == 64)
            & F.col("StandardCost").between(1, 100)
            & F.col("Weight").between(33, 66)
        )
    )
    assert wrong.count() == 0


def test_choices_are_all_drawn_and_about_equally(spark):
    sizes = synth.generate(spark, "Product", 4000).groupBy("Size").count().collect()
    assert len(sizes) == 4 and all(700 < r["count"] < 1300 for r in sizes)


def test_first_keys(spark):
    first = {
        "Address": ("AddressId", 1), "Customer": ("CustomerId", 1000), "Product": ("ProductId", 2000),
        "ProductCategory": ("ProductCategoryID", 9000), "ProductDescription": ("ProductDescriptionID", 5000),
        "ProductModel": ("ProductModelID", 4000), "SalesOrderHeader": ("SalesOrderID", 3000),
        "SalesOrderDetail": ("SalesOrderDetailID", 5000),
    }
    for table, (key, start) in first.items():
        got = synth.generate(spark, table, 10).agg(F.min(key), F.max(key), F.count_distinct(key)).first()
        assert tuple(got) == (start, start + 9, 10), table


def test_models_step_after_the_first_row_and_every_sixth(spark):
    got = rows(synth.generate(spark, "ProductModelProductDescription", 200),
               "ProductDescriptionID", "ProductModelID", "Culture")
    model, expected = 4000, []
    for i in range(200):
        expected.append((5000 + i, model))
        if i % 6 == 0:
            model += 1
    assert [(d, m) for d, m, _ in got] == expected
    assert got[0][2] == "en"
    assert all(len({c for _, m, c in got if m == model}) == 1 for model in {m for _, m, _ in got})
    assert len({c for _, _, c in got}) > 1


def test_order_rules(spark):
    header = synth.generate(spark, "SalesOrderHeader", 500)
    wrong = header.where(
        ~(
            (F.col("SalesOrderNumber") == F.concat(F.lit("SO"), "SalesOrderID"))
            & (F.col("BillToAddressID") == F.col("ShipToAddressID"))
            & F.col("ShipToAddressID").between(620, 1150)
            & (F.col("Status") == 5)
            & (F.col("DueDate") == F.col("ModifiedDate"))
            & (F.datediff("DueDate", "OrderDate") == 10)
            & (F.datediff("DueDate", "ShipDate") == 7)
            & F.col("SubTotal").between(100, 300)
            & (F.col("TotalDue") == F.expr("SubTotal + TaxAmt + Freight"))
            & (F.abs(F.expr("TaxAmt - SubTotal * 0.08000003BD")) < 0.0001)
            & (F.abs(F.expr("Freight - TaxAmt * 0.31249973BD")) < 0.0001)
        )
    )
    assert wrong.count() == 0
    detail = synth.generate(spark, "SalesOrderDetail", 500)
    assert detail.where("LineTotal != OrderQty * (UnitPrice - UnitPriceDiscount)").count() == 0
    assert detail.where("not OrderQty between 0 and 25").count() == 0


def test_keys_beyond_an_integer(spark):
    first = synth.generate(spark, "ProductModelProductDescription", 5, id_type="bigint")
    numbers = spark.range(synth.PRIME, synth.PRIME + 5)
    later = synth.generate_from(numbers, "ProductModelProductDescription", id_type="bigint")
    assert rows(later, "ProductDescriptionID")[0] == (synth.PRIME + 5000,)
    assert first.union(later).select("rowguid").distinct().count() == 10
