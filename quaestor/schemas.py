"""Explicit schemas of the tables the jobs read and write."""

from pyspark.sql import types as T

ITEM = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField(
            "faq_pairs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("question", T.StringType()),
                        T.StructField("answer", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

CORPUS = T.StructType(
    [
        T.StructField("faq_id", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("source_url", T.StringType()),
    ]
)

QUERY = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("query", T.StringType())]
)

WORD = T.StructType([T.StructField("word", T.StringType())])

VOCABULARY = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("freq", T.LongType())]
)

ACCESS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

CHAT_QUERY = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("query_id", T.LongType()),
        T.StructField("query", T.StringType()),
    ]
)
