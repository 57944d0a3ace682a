"""All registered queries: name -> (Spark function, SQL or None)."""

from seqloom.suite import evidence, fits, flows, library, rows, scores, sequences, streams

QUERIES: dict = {}
for _module in (scores, sequences, rows, evidence, fits, library, streams, flows):
    QUERIES.update(_module.QUERIES)
