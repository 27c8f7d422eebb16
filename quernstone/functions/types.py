"""Names of Postgres types in four vocabularies: TypeScript, Python, a neutral schema and model fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# For each target, its name of a Postgres type.
TYPESCRIPT = {
    "uuid": "string", "text": "string", "_text": "string[]", "_varchar": "string[]", "character varying": "string", "varchar": "string",
    "bool": "boolean", "int2": "number", "int4": "number", "int8": "number", "float4": "number", "float8": "number", "_uuid": "string[]",
    "_jsonb": "Record<string, unknown>[]", "jsonb": "Record<string, unknown>", "json": "Record<string, unknown>", "boolean": "boolean",
    "smallint": "number", "bigint": "number", "integer": "number", "real": "number", "double precision": "number", "numeric": "number",
    "jsonb[]": "Record<string, unknown>[]", "data_type": "string", "data_source": "string", "data_destination": "string",
    "destination_component": "string", "function_role": "string", "broker_role": "string", "model_role": "string",
    "cognition_matrices": "string", "recipe_status": "string", "timestamp": "Date", "timestamp with time zone": "Date", "date": "Date",
    "time": "Date", "interval": "string", "bytea": "Uint8Array", "array": "any[]", "hstore": "Record<string, string>",
    "point": "{x: number, y: number}", "line": "{a: number, b: number, c: number}",
    "lseg": "{start: {x: number, y: number}, end: {x: number, y: number}}",
    "box": "{topRight: {x: number, y: number}, bottomLeft: {x: number, y: number}}",
    "path": "{points: {x: number, y: number}[], closed: boolean}", "polygon": "{x: number, y: number}[]",
    "circle": "{center: {x: number, y: number}, radius: number}", "cidr": "string", "inet": "string", "macaddr": "string",
    "tsvector": "string", "tsquery": "string", "uuid[]": "string[]", "text[]": "string[]", "integer[]": "number[]",
    "boolean[]": "boolean[]", "char[]": "string[]", "varchar[]": "string[]", "xml": "string", "money": "string", "bit": "string",
    "bit varying": "string", "timetz": "string", "timestamptz": "Date", "txid_snapshot": "string", "enum": "string", "ARRAY": "any[]",
    "USER-DEFINED": "string",
}
PYTHON = {
    "uuid": "str", "text": "str", "character varying": "str", "boolean": "bool", "smallint": "int", "bigint": "int", "integer": "int",
    "real": "float", "double precision": "float", "numeric": "Decimal", "jsonb": "Dict[str, Any]", "jsonb[]": "List[Dict[str, Any]]",
    "json": "Dict[str, Any]", "data_type": "str", "data_source": "str", "data_destination": "str", "destination_component": "str",
    "function_role": "str", "broker_role": "str", "model_role": "str", "cognition_matrices": "str", "recipe_status": "str",
    "timestamp": "datetime", "timestamp with time zone": "datetime", "date": "date", "time": "time", "interval": "timedelta",
    "bytea": "bytes", "array": "List[Any]", "hstore": "Dict[str, str]", "point": "Tuple[float, float]",
    "line": "Tuple[float, float, float]", "lseg": "Tuple[Tuple[float, float], Tuple[float, float]]",
    "box": "Tuple[Tuple[float, float], Tuple[float, float]]", "path": "List[Tuple[float, float]]",
    "polygon": "List[Tuple[float, float]]", "circle": "Tuple[Tuple[float, float], float]", "cidr": "str", "inet": "str",
    "macaddr": "str", "tsvector": "str", "tsquery": "str", "uuid[]": "List[str]", "text[]": "List[str]", "integer[]": "List[int]",
    "boolean[]": "List[bool]", "char[]": "List[str]", "varchar[]": "List[str]", "xml": "str", "money": "Decimal", "bit": "str",
    "bit varying": "str", "timetz": "time", "timestamptz": "datetime", "txid_snapshot": "str", "enum": "str",
}
SCHEMA = {
    "uuid": "uuid", "text": "string", "_text": "string[]", "character varying": "string", "varchar": "string", "_varchar": "string[]",
    "bool": "boolean", "int2": "number", "int4": "number", "int8": "number", "float4": "number", "float8": "number", "_uuid": "uuid",
    "_jsonb": "object", "jsonb": "object", "json": "object", "boolean": "boolean", "smallint": "number", "bigint": "number",
    "integer": "number", "real": "number", "double precision": "number", "numeric": "number", "jsonb[]": "objectArray",
    "data_type": "string", "data_source": "string", "data_destination": "string", "destination_component": "string",
    "function_role": "string", "broker_role": "string", "model_role": "string", "cognition_matrices": "string",
    "recipe_status": "string", "timestamp": "date", "timestamp with time zone": "date", "date": "date", "time": "string",
    "interval": "string", "bytea": "any", "array": "any[]", "hstore": "object", "point": "tuple", "line": "tuple", "lseg": "tuple",
    "box": "tuple", "path": "array", "polygon": "array", "circle": "object", "cidr": "string", "inet": "string", "macaddr": "string",
    "tsvector": "string", "tsquery": "string", "uuid[]": "stringArray", "text[]": "stringArray", "integer[]": "number[]",
    "boolean[]": "boolean[]", "char[]": "stringArray", "varchar[]": "stringArray", "xml": "string", "money": "string",
    "bit": "string", "bit varying": "string", "timetz": "string", "timestamptz": "date", "txid_snapshot": "string", "enum": "enum",
    "ARRAY": "array", "USER-DEFINED": "string",
}
FIELD = {
    "uuid": "UUIDField", "text": "TextField", "_text": "TextArrayField", "_varchar": "TextArrayField", "_bpchar": "TextArrayField",
    "_uuid": "UUIDArrayField", "_jsonb": "JSONBArrayField", "_json": "JSONBArrayField", "_bool": "BooleanArrayField",
    "_int2": "SmallIntegerArrayField", "_int4": "IntegerArrayField", "_int8": "BigIntegerArrayField", "_float4": "FloatArrayField",
    "_float8": "FloatArrayField", "_numeric": "NumericArrayField", "_date": "DateArrayField", "_time": "TimeArrayField",
    "_timetz": "TimeArrayField", "_timestamp": "DateArrayField", "_timestamptz": "DateArrayField", "_inet": "IPNetworkArrayField",
    "_cidr": "IPNetworkArrayField", "_macaddr": "TextArrayField", "_hstore": "HStoreArrayField", "character varying": "CharField",
    "varchar": "CharField", "bool": "BooleanField", "int2": "SmallIntegerField", "int4": "IntegerField", "int8": "BigIntegerField",
    "float4": "FloatField", "float8": "FloatField", "jsonb": "JSONBField", "json": "JSONField", "boolean": "BooleanField",
    "smallint": "SmallIntegerField", "bigint": "BigIntegerField", "integer": "IntegerField", "real": "FloatField",
    "double precision": "FloatField", "numeric": "DecimalField", "jsonb[]": "JSONBArrayField", "data_type": "CharField",
    "data_source": "CharField", "data_destination": "CharField", "destination_component": "CharField", "function_role": "CharField",
    "broker_role": "CharField", "model_role": "CharField", "cognition_matrices": "CharField", "recipe_status": "CharField",
    "timestamp": "DateTimeField", "timestamp with time zone": "DateTimeField", "date": "DateField", "time": "TimeField",
    "interval": "TimeDeltaField", "bytea": "BinaryField", "array": "PrimitiveArrayField", "hstore": "HStoreField",
    "point": "PointField", "line": "PrimitiveArrayField", "lseg": "PrimitiveArrayField", "box": "PrimitiveArrayField",
    "path": "ArrayField", "polygon": "ArrayField", "circle": "PrimitiveArrayField", "cidr": "IPNetworkField",
    "inet": "IPAddressField", "macaddr": "MacAddressField", "tsvector": "TextField", "tsquery": "TextField",
    "uuid[]": "UUIDArrayField", "text[]": "TextArrayField", "character varying[]": "TextArrayField", "varchar[]": "TextArrayField",
    "char[]": "TextArrayField", "citext[]": "TextArrayField", "integer[]": "IntegerArrayField", "int[]": "IntegerArrayField",
    "int4[]": "IntegerArrayField", "bigint[]": "BigIntegerArrayField", "int8[]": "BigIntegerArrayField",
    "smallint[]": "SmallIntegerArrayField", "int2[]": "SmallIntegerArrayField", "boolean[]": "BooleanArrayField",
    "bool[]": "BooleanArrayField", "real[]": "FloatArrayField", "float4[]": "FloatArrayField",
    "double precision[]": "FloatArrayField", "float8[]": "FloatArrayField", "numeric[]": "NumericArrayField",
    "decimal[]": "NumericArrayField", "json[]": "JSONBArrayField", "date[]": "DateArrayField", "time[]": "TimeArrayField",
    "time without time zone[]": "TimeArrayField", "time with time zone[]": "TimeArrayField", "timestamp[]": "DateArrayField",
    "timestamp without time zone[]": "DateArrayField", "timestamp with time zone[]": "DateArrayField",
    "timestamptz[]": "DateArrayField", "inet[]": "IPNetworkArrayField", "cidr[]": "IPNetworkArrayField",
    "macaddr[]": "TextArrayField", "hstore[]": "HStoreArrayField", "xml": "TextField", "money": "MoneyField", "bit": "CharField",
    "bit varying": "CharField", "timetz": "TimeField", "timestamptz": "DateTimeField", "txid_snapshot": "CharField",
    "enum": "EnumField", "ARRAY": "ArrayField", "USER-DEFINED": "CharField",
}
#: What a registered enum becomes, and what a miss becomes.
ENUM_AS = {"typescript": "string", "python": "str", "schema": "string", "field": "CharField"}
MISS = {"typescript": ("any // ERROR! Original Value: ", " Type Not Found!"), "schema": ("any // ERROR! Original Value: ", " Type Not Found!"), "field": ("Any # ERROR! Original Value: ", " Field Not Found!")}
_BY_TARGET = {"typescript": TYPESCRIPT, "python": PYTHON, "schema": SCHEMA, "field": FIELD}


def type_map(target: str, enums: tuple[str, ...] = ()) -> dict[str, str]:
    """Postgres type to its name in the target vocabulary, registered enums included."""
    return _BY_TARGET[target] | dict.fromkeys(enums, ENUM_AS[target])


def _lookup(c: Column, known: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[c]


def mapped_type(c: Column, target: str, enums: tuple[str, ...] = ()) -> Column:
    """The target's name of a type; a name of the target and `column_name` stay; a miss gives a text that says so."""
    known = type_map(target, enums)
    before, after = MISS[target]
    same = F.when(c.isin(*sorted({*known.values(), "column_name"})), c)
    return F.coalesce(_lookup(c, known), same, F.concat(F.lit(before), F.coalesce(c, F.lit("None")), F.lit(after)))


def python_type(c: Column, enums: tuple[str, ...] = ()) -> Column:
    return F.when(c.isNotNull(), F.coalesce(_lookup(F.lower(c), type_map("python", enums)), F.lit("Any")))


def legacy_typescript_type(c: Column, enums: tuple[str, ...] = ()) -> Column:
    return _lookup(F.lower(c), type_map("typescript", enums))


def annotation(c: Column, language: str = "typescript", enums: tuple[str, ...] = ()) -> Column:
    if language.lower() == "python":
        return python_type(c, enums)
    if language.lower() == "typescript":
        return F.when(c.isNotNull(), F.coalesce(legacy_typescript_type(c, enums), F.lit("any")))
    return F.when(c.isNotNull(), F.lit("Unknown language"))
