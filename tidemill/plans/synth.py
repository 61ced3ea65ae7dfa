"""Generated sales tables.

Every value is a function of the row number, the seed and the column, so a table
comes out the same at any size, partitioning or retry, and no row depends on
another. Row numbers come from ``spark.range`` or from any table with a column of
distinct whole numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sinks.files import overwrite_parquet

# Two primes below 2^31: products with the multipliers stay inside a bigint.
PRIME = 2147483647
OTHER_PRIME = 2147483629
# What every further PRIME rows shift the numbers by.
CYCLE_STEP = 7919

# Rows of each table unless told otherwise.
ROWS = {
    "Address": 500,
    "Customer": 900,
    "CustomerAddress": 500,
    "Product": 350,
    "ProductCategory": 100,
    "ProductDescription": 810,
    "ProductModel": 180,
    "ProductModelProductDescription": 810,
    "SalesOrderHeader": 85,
    "SalesOrderDetail": 600,
}
# The choices a column is drawn from.
PRODUCT_NAMES = (
    "HL Mountain Frame",
    "LL Road Frame",
    "Mountain Bike Socks",
    "ML Fork",
    "Racing Socks",
)
SIZES = ("S", "M", "L", "XL")
CULTURES = ("en", "ar", "fr", "th", "he", "zh-cht")
ADDRESS_TYPES = ("Main Office", "Shipping")

WORDS = ("amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "harbor", "iris", "juniper")
COLORS = ("black", "blue", "green", "red", "silver", "white", "yellow")
TITLES = ("Dr.", "Mr.", "Mrs.", "Ms.")
SUFFIXES = ("II", "III", "Jr.", "MD", "PhD")
LATEST_SECOND = 1_700_000_000


@dataclass(frozen=True)
class Stream:
    """The constants that make one column's numbers differ from another's."""

    multiplier: int
    offset: int

    @classmethod
    def of(cls, seed: int, table: str, column: str) -> Stream:
        name = f"{seed}/{table}/{column}"
        return cls(
            1 + zlib.crc32(f"{name}/multiplier".encode()) % 1_000_000,
            zlib.crc32(f"{name}/offset".encode()) % PRIME,
        )


class Draw:
    """Columns drawn for one table from the row number ``i``."""

    def __init__(self, seed: int, table: str, id_type: str = "int"):
        self.seed = seed
        self.table = table
        self.id_type = id_type

    def id(self, start: int) -> Column:
        """The row's key."""
        return (F.col("i") + start).cast(self.id_type)

    def number(self, column: str, index: Column | None = None) -> Column:
        """A whole number in ``[0, PRIME)``."""
        stream = Stream.of(self.seed, self.table, column)
        i = F.col("i") if index is None else index
        cycle = F.call_function("div", i, F.lit(PRIME))
        x = (i % PRIME * stream.multiplier + cycle * CYCLE_STEP + stream.offset) % PRIME
        x = (x * 69621 + stream.offset) % OTHER_PRIME
        return (x * 39373) % PRIME

    def between(self, column: str, low: int, high: int) -> Column:
        """A whole number, both ends possible."""
        return F.lit(low) + self.number(column) % (high - low + 1)

    def scaled(self, column: str, low: int, high: int, scale: int, kind: str) -> Column:
        """A decimal between ``low`` and ``high`` with ``scale`` digits."""
        units = self.between(column, low * 10**scale, high * 10**scale)
        step = F.expr(f"{10**-scale:.{scale}f}BD")
        return (units.cast("decimal(12,0)") * step).cast(kind)

    def choice(self, column: str, values: Sequence[str], index: Column | None = None) -> Column:
        options = F.array(*[F.lit(v) for v in values])
        return F.element_at(options, (self.number(column, index) % len(values) + 1).cast("int"))

    def flag(self, column: str) -> Column:
        return self.number(column) % 2 == 0

    def stamp(self, column: str = "ModifiedDate") -> Column:
        return F.timestamp_seconds(self.number(column) % LATEST_SECOND)

    def digits(self, column: str, count: int) -> Column:
        return F.lpad((self.number(column) % 10**count).cast("string"), count, "0")

    def hex8(self, column: str) -> Column:
        return F.lpad(F.lower(F.hex(self.number(column))), 8, "0")

    def guid(self) -> Column:
        a, b, c, d = (self.hex8(f"rowguid{n}") for n in range(4))
        return F.concat_ws(
            "-", a, F.substring(b, 1, 4), F.substring(b, 5, 4), F.substring(c, 1, 4),
            F.concat(F.substring(c, 5, 4), d),
        )

    def words(self, column: str, count: int) -> Column:
        return F.concat_ws(" ", *[self.choice(f"{column}{n}", WORDS) for n in range(count)])


def _address(d: Draw) -> dict[str, Column]:
    return {
        "AddressId": d.id(1),
        "AddressLine1": F.concat_ws(
            " ", d.between("number", 1, 9999).cast("string"), d.choice("street", WORDS), F.lit("Street")
        ),
        "AddressLine2": F.concat_ws(" ", d.choice("way", WORDS), F.lit("Way")),
        "City": F.concat(d.choice("city", WORDS), F.lit("ville")),
        "StateProvince": d.choice("state", WORDS),
        "CountryRegion": d.choice("country", WORDS),
        "PostalCode": d.digits("postcode", 5),
        "rowguid": d.guid(),
        "ModifiedDate": d.stamp(),
    }


def _customer(d: Draw) -> dict[str, Column]:
    return {
        "CustomerId": d.id(1000),
        "NameStyle": d.flag("style"),
        "Title": d.choice("title", TITLES),
        "FirstName": d.choice("first", WORDS),
        "MiddleName": F.lit(""),
        "LastName": d.choice("last", WORDS),
        "Suffix": d.choice("suffix", SUFFIXES),
        "CompanyName": F.concat_ws(" ", d.words("company", 2), F.lit("Ltd")),
        "SalesPerson": F.concat(F.lit("adventure-works\\"), d.choice("seller", WORDS)),
        "EmailAddress": F.concat(d.choice("mail", WORDS), d.digits("mailno", 6), F.lit("@example.org")),
        "Phone": F.concat_ws("-", F.lit("555"), d.digits("phone", 7)),
        "PasswordHash": F.md5(F.concat(F.lit("hash"), d.number("hash").cast("string"))),
        "PasswordSalt": d.hex8("salt"),
        "rowguid": d.guid(),
        "ModifiedDate": d.stamp(),
    }


def _customer_address(d: Draw) -> dict[str, Column]:
    return {
        "CustomerId": d.id(1000),
        "AddressId": d.id(1),
        "AddressType": d.choice("type", ADDRESS_TYPES),
        "rowguid": d.guid(),
        "ModifiedDate": d.stamp(),
    }


def _product(d: Draw) -> dict[str, Column]:
    modified = d.stamp()
    color, size = d.choice("color", COLORS), d.choice("size", SIZES)
    sell_end = modified - F.expr("interval 5 days")
    photo = F.concat(
        F.sha2(F.concat(F.lit("photo"), d.number("photo1").cast("string")), 256),
        F.sha2(F.concat(F.lit("photo"), d.number("photo2").cast("string")), 256),
    )
    return {
        "ProductId": d.id(2000),
        "Name": F.concat(d.choice("name", PRODUCT_NAMES), F.lit(" - "), color, F.lit(","), size),
        "ProductNumber": F.concat(F.lit("PN-"), d.digits("number", 6)),
        "Color": color,
        "StandardCost": d.scaled("cost", 1, 100, 4, "decimal(19,4)"),
        "ListPrice": d.scaled("price", 1, 100, 4, "decimal(19,4)"),
        "Size": size,
        "Weight": d.scaled("weight", 33, 66, 2, "decimal(8,2)"),
        "ProductCategoryId": d.between("category", 9000, 9100).cast("int"),
        "ProductModelId": d.between("model", 4000, 4150).cast("int"),
        "ModifiedDate": modified,
        "SellStartDate": modified - F.expr("interval 10 days"),
        "SellEndDate": sell_end,
        "DiscontinuedDate": sell_end + F.expr("interval 1 day"),
        "ThumbNailPhoto": F.unhex(photo),
        "ThumbnailPhotoFileName": F.concat(d.choice("file", WORDS), F.lit(".gif")),
        "rowguid": d.guid(),
    }


def _product_category(d: Draw) -> dict[str, Column]:
    return {
        "ProductCategoryID": d.id(9000),
        "ParentProductCategoryID": d.id(9000),
        "Name": d.choice("name", WORDS),
        "rowguid": d.guid(),
        "ModifiedDate": d.stamp(),
    }


def _product_description(d: Draw) -> dict[str, Column]:
    return {
        "ProductDescriptionID": d.id(5000),
        "Description": d.words("text", 6),
        "rowguid": d.guid(),
        "ModifiedDate": d.stamp(),
    }


def _product_model(d: Draw) -> dict[str, Column]:
    return {
        "ProductModelID": d.id(4000),
        "Name": d.choice("name", PRODUCT_NAMES),
        "CatalogDescription": d.words("text", 6),
        "rowguid": d.guid(),
        "ModifiedDate": d.stamp(),
    }


def _product_model_description(d: Draw) -> dict[str, Column]:
    # The model steps after the first row and then after every sixth; each model has
    # one culture, and the first is English.
    group = F.expr("(i + 5) div 6")
    culture = d.choice("culture", CULTURES, group)
    return {
        "ProductModelID": (group + 4000).cast(d.id_type),
        "ProductDescriptionID": d.id(5000),
        "Culture": F.when(F.col("i") == 0, F.lit(CULTURES[0])).otherwise(culture),
        "rowguid": d.guid(),
        "ModifiedDate": d.stamp(),
    }


def _sales_order_header(d: Draw) -> dict[str, Column]:
    modified = d.stamp()
    money = "decimal(19,4)"
    subtotal = d.scaled("subtotal", 100, 300, 4, money)
    tax = (subtotal * F.expr("0.08000003BD")).cast(money)
    freight = (tax * F.expr("0.31249973BD")).cast(money)
    address = d.between("address", 620, 1150).cast("int")
    return {
        "SalesOrderID": d.id(3000),
        "RevisionNumber": d.between("revision", 1, 5).cast("int"),
        "ModifiedDate": modified,
        "OrderDate": modified - F.expr("interval 10 days"),
        "DueDate": modified,
        "ShipDate": modified - F.expr("interval 7 days"),
        "Status": F.lit(5),
        "OnlineOrderFlag": d.flag("online"),
        "SalesOrderNumber": F.concat(F.lit("SO"), d.id(3000).cast("string")),
        "PurchaseOrderNumber": F.concat(F.lit("PO"), d.digits("purchase", 9)),
        "AccountNumber": F.concat(F.lit("10-4020-000"), d.digits("account", 3)),
        "CustomerID": d.id(1000),
        "ShipToAddressID": address,
        "BillToAddressID": address,
        "ShipMethod": F.lit("CARGO TRANSPORT 5"),
        "CreditCardApprovalCode": F.lit(""),
        "SubTotal": subtotal,
        "TaxAmt": tax,
        "Freight": freight,
        "TotalDue": (subtotal + tax + freight).cast(money),
        "Comment": d.words("comment", 6),
        "rowguid": d.guid(),
    }


def _sales_order_detail(d: Draw) -> dict[str, Column]:
    money = "decimal(19,4)"
    quantity = d.between("quantity", 0, 25).cast("int")
    price = d.scaled("price", 30, 1500, 4, money)
    discount = d.scaled("discount", 0, 1, 2, money)
    return {
        "SalesOrderID": d.id(3000),
        "SalesOrderDetailID": d.id(5000),
        "OrderQty": quantity,
        "ProductID": d.id(2000),
        "UnitPrice": price,
        "UnitPriceDiscount": discount,
        "LineTotal": (quantity * (price - discount)).cast("decimal(38,6)"),
        "rowguid": d.guid(),
        "ModifiedDate": d.stamp(),
    }


COLUMNS: Mapping[str, Callable[[Draw], dict[str, Column]]] = {
    "Address": _address,
    "Customer": _customer,
    "CustomerAddress": _customer_address,
    "Product": _product,
    "ProductCategory": _product_category,
    "ProductDescription": _product_description,
    "ProductModel": _product_model,
    "ProductModelProductDescription": _product_model_description,
    "SalesOrderHeader": _sales_order_header,
    "SalesOrderDetail": _sales_order_detail,
}


def generate_from(
    numbers: DataFrame, table: str, seed: int = 0, id_type: str = "int"
) -> DataFrame:
    """Rows of ``table``, one for each value of the only column of ``numbers``.

    Keys are declared as integers; more than two thousand million rows need ``bigint``.
    """
    (column,) = numbers.columns
    indexed = numbers.select(F.col(column).cast("bigint").alias("i"))
    columns = COLUMNS[table](Draw(seed, table, id_type))
    return indexed.select(*[c.alias(name) for name, c in columns.items()])


def generate(
    spark: SparkSession,
    table: str,
    rows: int | None = None,
    seed: int = 0,
    id_type: str = "int",
) -> DataFrame:
    """``rows`` rows of ``table``."""
    numbers = spark.range(ROWS[table] if rows is None else rows)
    return generate_from(numbers, table, seed, id_type)


def generate_and_land(
    spark: SparkSession,
    folder: str,
    rows: Mapping[str, int] | None = None,
    seed: int = 0,
) -> None:
    """Write the tables named in ``rows``, or all at their usual size, to ``folder``."""
    for table, count in (ROWS if rows is None else rows).items():
        overwrite_parquet(generate(spark, table, count, seed), f"{folder}/{table}")
