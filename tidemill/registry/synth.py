"""Generated tables, one row for each row of a given table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill import adapters
from tidemill.plans import synth
from tidemill.registry.query import Query, plain

SEED = 7

# Which table's keys number the generated rows.
NUMBERS = {
    "Address": ("customer", "c_custkey"),
    "Customer": ("customer", "c_custkey"),
    "CustomerAddress": ("customer", "c_custkey"),
    "Product": ("part", "p_partkey"),
    "ProductCategory": ("supplier", "s_suppkey"),
    "ProductDescription": ("part", "p_partkey"),
    "ProductModel": ("part", "p_partkey"),
    "ProductModelProductDescription": ("part", "p_partkey"),
    "SalesOrderHeader": ("orders", "o_orderkey"),
    "SalesOrderDetail": ("orders", "o_orderkey"),
}


def generated(table: str) -> Callable[[SparkSession, str], DataFrame]:
    source, key = NUMBERS[table]

    def build(spark: SparkSession, folder: str) -> DataFrame:
        numbers = adapters.table(spark, folder, source).select(key)
        return plain(synth.generate_from(numbers, table, SEED, "bigint"))

    return build


# -- the same in SQL ------------------------------------------------------------------


class _Sql:
    """The drawing rules as SQL text."""

    def __init__(self, table: str):
        self.table = table

    def number(self, column: str, index: str = "i") -> str:
        s = synth.Stream.of(SEED, self.table, column)
        cycle = f"({index}) // {synth.PRIME} * {synth.CYCLE_STEP}"
        first = f"(({index}) % {synth.PRIME} * {s.multiplier} + {cycle} + {s.offset}) % {synth.PRIME}"
        second = f"(({first}) * 69621 + {s.offset}) % {synth.OTHER_PRIME}"
        return f"(({second}) * 39373 % {synth.PRIME})"

    def between(self, column: str, low: int, high: int) -> str:
        return f"({low} + {self.number(column)} % {high - low + 1})"

    def scaled(self, column: str, low: int, high: int, scale: int) -> str:
        units = self.between(column, low * 10**scale, high * 10**scale)
        return f"CAST(CAST({units} AS DECIMAL(12,0)) * {10**-scale:.{scale}f} AS DECIMAL(19,4))"

    def choice(self, column: str, values: tuple[str, ...], index: str = "i") -> str:
        listed = ", ".join(f"'{v}'" for v in values)
        return f"([{listed}])[1 + {self.number(column, index)} % {len(values)}]"

    def flag(self, column: str) -> str:
        return f"({self.number(column)} % 2 = 0)"

    def stamp(self) -> str:
        return f"make_timestamp({self.number('ModifiedDate')} % {synth.LATEST_SECOND} * 1000000)"

    def digits(self, column: str, count: int) -> str:
        return f"lpad(CAST({self.number(column)} % {10**count} AS VARCHAR), {count}, '0')"

    def hex8(self, column: str) -> str:
        return f"lpad(lower(to_hex({self.number(column)})), 8, '0')"

    def guid(self) -> str:
        a, b, c, d = (self.hex8(f"rowguid{n}") for n in range(4))
        return (
            f"{a} || '-' || substr({b}, 1, 4) || '-' || substr({b}, 5, 4) || '-' || "
            f"substr({c}, 1, 4) || '-' || substr({c}, 5, 4) || {d}"
        )

    def words(self, column: str, count: int) -> str:
        return " || ' ' || ".join(self.choice(f"{column}{n}", synth.WORDS) for n in range(count))

    def sha(self, column: str) -> str:
        return f"sha256('photo' || {self.number(column)})"


def _double(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def _columns(table: str) -> dict[str, str]:
    s = _Sql(table)
    shared = {"rowguid": s.guid(), "ModifiedDate": s.stamp()}
    if table == "Address":
        return {
            "AddressId": "i + 1",
            "AddressLine1": (
                f"{s.between('number', 1, 9999)} || ' ' || {s.choice('street', synth.WORDS)} || ' Street'"
            ),
            "AddressLine2": f"{s.choice('way', synth.WORDS)} || ' Way'",
            "City": f"{s.choice('city', synth.WORDS)} || 'ville'",
            "StateProvince": s.choice("state", synth.WORDS),
            "CountryRegion": s.choice("country", synth.WORDS),
            "PostalCode": s.digits("postcode", 5),
            **shared,
        }
    if table == "Customer":
        return {
            "CustomerId": "i + 1000",
            "NameStyle": s.flag("style"),
            "Title": s.choice("title", synth.TITLES),
            "FirstName": s.choice("first", synth.WORDS),
            "MiddleName": "''",
            "LastName": s.choice("last", synth.WORDS),
            "Suffix": s.choice("suffix", synth.SUFFIXES),
            "CompanyName": f"{s.words('company', 2)} || ' Ltd'",
            "SalesPerson": rf"'adventure-works\' || {s.choice('seller', synth.WORDS)}",
            "EmailAddress": (
                f"{s.choice('mail', synth.WORDS)} || {s.digits('mailno', 6)} || '@example.org'"
            ),
            "Phone": f"'555-' || {s.digits('phone', 7)}",
            "PasswordHash": f"md5('hash' || {s.number('hash')})",
            "PasswordSalt": s.hex8("salt"),
            **shared,
        }
    if table == "CustomerAddress":
        return {
            "CustomerId": "i + 1000",
            "AddressId": "i + 1",
            "AddressType": s.choice("type", synth.ADDRESS_TYPES),
            **shared,
        }
    if table == "Product":
        color, size = s.choice("color", synth.COLORS), s.choice("size", synth.SIZES)
        return {
            "ProductId": "i + 2000",
            "Name": f"{s.choice('name', synth.PRODUCT_NAMES)} || ' - ' || {color} || ',' || {size}",
            "ProductNumber": f"'PN-' || {s.digits('number', 6)}",
            "Color": color,
            "StandardCost": _double(s.scaled("cost", 1, 100, 4)),
            "ListPrice": _double(s.scaled("price", 1, 100, 4)),
            "Size": size,
            "Weight": _double(s.scaled("weight", 33, 66, 2)),
            "ProductCategoryId": s.between("category", 9000, 9100),
            "ProductModelId": s.between("model", 4000, 4150),
            "SellStartDate": f"{s.stamp()} - INTERVAL 10 DAY",
            "SellEndDate": f"{s.stamp()} - INTERVAL 5 DAY",
            "DiscontinuedDate": f"{s.stamp()} - INTERVAL 4 DAY",
            "ThumbNailPhoto": f"{s.sha('photo1')} || {s.sha('photo2')}",
            "ThumbnailPhotoFileName": f"{s.choice('file', synth.WORDS)} || '.gif'",
            **shared,
        }
    if table == "ProductCategory":
        return {
            "ProductCategoryID": "i + 9000",
            "ParentProductCategoryID": "i + 9000",
            "Name": s.choice("name", synth.WORDS),
            **shared,
        }
    if table == "ProductDescription":
        return {"ProductDescriptionID": "i + 5000", "Description": s.words("text", 6), **shared}
    if table == "ProductModel":
        return {
            "ProductModelID": "i + 4000",
            "Name": s.choice("name", synth.PRODUCT_NAMES),
            "CatalogDescription": s.words("text", 6),
            **shared,
        }
    if table == "ProductModelProductDescription":
        culture = s.choice("culture", synth.CULTURES, "(i + 5) // 6")
        return {
            "ProductModelID": "4000 + (i + 5) // 6",
            "ProductDescriptionID": "i + 5000",
            "Culture": f"CASE WHEN i = 0 THEN 'en' ELSE {culture} END",
            **shared,
        }
    if table == "SalesOrderHeader":
        subtotal = s.scaled("subtotal", 100, 300, 4)
        tax = f"CAST({subtotal} * 0.08000003 AS DECIMAL(19,4))"
        freight = f"CAST({tax} * 0.31249973 AS DECIMAL(19,4))"
        return {
            "SalesOrderID": "i + 3000",
            "RevisionNumber": s.between("revision", 1, 5),
            "OrderDate": f"{s.stamp()} - INTERVAL 10 DAY",
            "DueDate": s.stamp(),
            "ShipDate": f"{s.stamp()} - INTERVAL 7 DAY",
            "Status": "5",
            "OnlineOrderFlag": s.flag("online"),
            "SalesOrderNumber": "'SO' || (i + 3000)",
            "PurchaseOrderNumber": f"'PO' || {s.digits('purchase', 9)}",
            "AccountNumber": f"'10-4020-000' || {s.digits('account', 3)}",
            "CustomerID": "i + 1000",
            "ShipToAddressID": s.between("address", 620, 1150),
            "BillToAddressID": s.between("address", 620, 1150),
            "ShipMethod": "'CARGO TRANSPORT 5'",
            "CreditCardApprovalCode": "''",
            "SubTotal": _double(subtotal),
            "TaxAmt": _double(tax),
            "Freight": _double(freight),
            "TotalDue": _double(f"{subtotal} + {tax} + {freight}"),
            "Comment": s.words("comment", 6),
            **shared,
        }
    price, discount = s.scaled("price", 30, 1500, 4), s.scaled("discount", 0, 1, 2)
    quantity = s.between("quantity", 0, 25)
    return {
        "SalesOrderID": "i + 3000",
        "SalesOrderDetailID": "i + 5000",
        "OrderQty": quantity,
        "ProductID": "i + 2000",
        "UnitPrice": _double(price),
        "UnitPriceDiscount": _double(discount),
        "LineTotal": _double(f"{quantity} * ({price} - {discount})"),
        **shared,
    }


def generated_sql(table: str) -> str:
    source, key = NUMBERS[table]
    columns = ", ".join(f'{sql} AS "{name}"' for name, sql in _columns(table).items())
    return f"SELECT {columns} FROM (SELECT {key} AS i FROM {source})"


QUERIES = {
    f"gen_{table.lower()}": Query(generated(table), generated_sql(table)) for table in NUMBERS
}
