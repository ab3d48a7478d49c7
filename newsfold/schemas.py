"""Declared schemas of every table the library reads or writes."""

from pyspark.sql import types as T


def _struct(**columns):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns.items()])


_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()

RAW_ARTICLE = _struct(
    article_url=_S,
    article_title=_S,
    article_text=_S,
    publish_date=_TS,
    published_method_found=_S,
    published_guess_accuracy=_S,
)
FETCHED_DOCUMENT = _struct(source=_S, url=_S, status=_I, body=_S, fetched_at=_TS)
NEWS_CSV = _struct(url=_S, title=_S)
HEADLINE_JSON = _struct(article_link=_S, headline=_S, is_sarcastic=_I)
HEADLINE = _struct(article_url=_S, article_title=_S, is_sarcastic=_I, title_length=_I, lang=_S)
#: The headline table with prepared words.
PREPARED = T.StructType([*HEADLINE.fields, T.StructField("article_title_preprocessed", T.ArrayType(_S))])
#: Which attempt at writing a crawl batch counts.
CRAWL_MANIFEST = _struct(batch=_S, attempt=_S, columns=T.ArrayType(_S))
RUN_RECORD = _struct(
    family=_S,
    run=_S,
    split=_S,
    training_data_size=_L,
    evaluation_data_size=_L,
    test_data_size=_L,
    precision=_D,
    recall=_D,
    f1=_D,
    accuracy=_D,
    true_negative=_L,
    false_positive=_L,
    false_negative=_L,
    true_positive=_L,
    parameters=T.MapType(_S, _S),
)
RESULT_FILE = T.StructType(
    [f for f in RUN_RECORD.fields if f.name not in ("family", "run", "split", "parameters")]
    + [
        T.StructField("kernel", _S),
        T.StructField("svm-regularization", _D),
        T.StructField("degree", _D),
        T.StructField("learning_rate", _D),
        T.StructField("per_device_train_batch_size", _I),
        T.StructField("weight_decay", _D),
        T.StructField("optim", _S),
    ]
)
