"""Labels, types and fixed values shared by every module."""

from pyspark.sql import types as T

LABELS = ("ORG", "NAME", "GEO")
TAGS = ("O", "B-ORG", "I-ORG", "B-NAME", "I-NAME", "B-GEO", "I-GEO")

# Identifier prefixes, label tables and character sets that have to
# be exactly these for the results to agree with existing corpora.
ARRAY_HASH_PREFIX = "mendeley-"
TOKEN_HASH_PREFIX = "uzner-v2-"
VARIANT_HASH_PREFIX = "cluster-"
ADDED_PREFIXES = (ARRAY_HASH_PREFIX, TOKEN_HASH_PREFIX)
ARRAY_LABELS = {"PER": "NAME", "LOC": "GEO", "ORG": "ORG"}
TOKEN_LABELS = {
    "PER": "NAME",
    "PERSON": "NAME",
    "LOC": "GEO",
    "LOCATION": "GEO",
    "GPE": "GEO",
    "GEOPOLITICALENTITY": "GEO",
    "ORG": "ORG",
    "ORGANIZATION": "ORG",
}
NO_SPACE_BEFORE = ",.!?;:%)]}»”’"
NO_SPACE_AFTER = "([{«“"
SUFFIX_CHARS = "'’ʻʼ-_"
O_G_APOSTROPHES = "'‘’ʼ`"
O_G_LETTER_MARK = "ʻ"
VALUE_APOSTROPHES = "`´‘’ʼʻʹ"
EDGE_PUNCTUATION = ' \t\r\n.,;:!?()[]{}"«»“”'

ENTITY = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)
ENTITIES = T.ArrayType(ENTITY)
TOKENS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)
ENTITIES_DDL = "array<struct<label:string,start:bigint,end:bigint>>"
