"""evalspark: model-evaluation analytics as Spark plans.

functions/   Column builders (text, labels, entities, hashing) - narrow, codegen-friendly
operators/   DataFrame -> DataFrame operators (prepare, metrics, rouge, economics, matrix,
             stats, decision, scoring)
sources/     readers / writers (results CSV, labelled text, task datasets, run store,
             wide prediction logs)
streaming/   incremental scoring with a file stream and a checkpointed Parquet sink
plans/       composed plans and the query catalog exposed by ``__spark_entry__``
"""

__version__ = "0.1.0"
