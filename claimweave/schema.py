"""The bill's data model: typed and raw records, and the paths evaluation walks.

The typed schema is written once; the raw one (all leaves strings), the paths and the lists
of money and date fields follow from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

#: Field names and types of a bill.
BLOCKS = {
    "hospital": "name string, address string, city string, state string, gstin string, hospital_type string",
    "patient": "name string, age int, sex string, uhid string, ip_number string, admission_date date, discharge_date date, ward_type string",
    "insurance": "insurer_name string, tpa_name string, policy_number string, claim_number string, employee_id string",
    "totals": "gross_amount decimal(18,2), discount decimal(18,2), cgst decimal(18,2), sgst decimal(18,2), net_amount decimal(18,2), "
    "advance_paid decimal(18,2), balance_due decimal(18,2), amount_in_words string",
}
LINE_ITEM = (
    "serial_no string, description string, service_date date, category string, quantity decimal(18,4), unit_rate decimal(18,2), "
    "amount decimal(18,2), hsn_code string, is_payable boolean, deduction_reason string"
)
CATEGORIES = (
    "room_rent", "nursing", "pharmacy", "consumables", "diagnostics", "radiology",
    "surgery", "professional_fees", "equipment", "administrative", "non_medical", "other",
)


#: Leaves by name; Spark's own parser asks for a running session, which importing a schema must not.
LEAVES = {"string": StringType(), "int": IntegerType(), "date": DateType(), "boolean": BooleanType(), "decimal(18,2)": DecimalType(18, 2), "decimal(18,4)": DecimalType(18, 4)}


def record(fields: str) -> StructType:
    return StructType([StructField(name, LEAVES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def _typed() -> StructType:
    blocks = {name: record(fields) for name, fields in BLOCKS.items()}
    order = ["hospital", "patient", "insurance", "line_items", "totals"]
    items = ArrayType(record(LINE_ITEM))
    return StructType([StructField(n, blocks.get(n, items)) for n in order])


def raw_mirror(kind: DataType) -> DataType:
    """The same shape with every leaf a string."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, raw_mirror(f.dataType)) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(raw_mirror(kind.elementType))
    return StringType()


TYPED_SCHEMA = _typed()
RAW_SCHEMA = raw_mirror(TYPED_SCHEMA)
FIELD_PATHS = tuple(f"{b}.{f}" for b in BLOCKS for f in TYPED_SCHEMA[b].dataType.fieldNames())
LINE_ITEM_FIELDS = tuple(TYPED_SCHEMA["line_items"].dataType.elementType.fieldNames())


def field_type(path: str) -> DataType:
    block, name = path.split(".")
    return TYPED_SCHEMA[block].dataType[name].dataType


def paths_of(kind: type[DataType]) -> tuple[str, ...]:
    return tuple(p for p in FIELD_PATHS if isinstance(field_type(p), kind))


MONEY_FIELD_PATHS = paths_of(DecimalType)
DATE_FIELD_PATHS = paths_of(DateType)


def special_tokens() -> list[str]:
    """Tags of all schema keys, each once, the category values that aren't keys, and the row separator."""
    keys = [*BLOCKS, "line_items", *(p.split(".")[1] for p in FIELD_PATHS), *LINE_ITEM_FIELDS]
    ordered = list(dict.fromkeys(keys))
    tags = [tag for key in ordered for tag in (f"<s_{key}>", f"</s_{key}>")]
    return [*tags, *(c for c in CATEGORIES if c not in ordered), "<sep/>"]


def reject_floats(df: DataFrame) -> DataFrame:
    """Money and quantities are decimals; a binary float among the columns or inside them is an error."""

    def floats(kind: DataType, at: str) -> list[str]:
        if isinstance(kind, StructType):
            return [x for f in kind for x in floats(f.dataType, f"{at}.{f.name}" if at else f.name)]
        if isinstance(kind, ArrayType):
            return floats(kind.elementType, at + "[]")
        return [at] if isinstance(kind, (DoubleType, FloatType)) else []

    if found := floats(df.schema, ""):
        raise TypeError(f"floats where decimals are asked for: {', '.join(found)}")
    return df


def long_fields(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row for each scalar path of a document struct: the kept columns, path and value as text."""
    value = lambda p: F.col(f"{column}.{p}").cast("string")
    pairs = F.array(*(F.struct(F.lit(p).alias("path"), value(p).alias("value")) for p in FIELD_PATHS))
    return df.select(*keep, F.inline(pairs))


def unknown_keys(json: Column, schema: StructType) -> Column:
    """Keys of a JSON object that the schema doesn't have, which reading would pass over in silence."""
    return F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*(F.lit(n) for n in schema.fieldNames())))
