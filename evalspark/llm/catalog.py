"""The registered queries of this subpackage and their oracle SQL."""

from evalspark.llm import (alignment, bpe, decontaminate, jaccard, language, licences, neighbours, preference, quality,
                           sharding, substrings, variants, warc)

MODULES = [preference, bpe, decontaminate, jaccard, language, substrings, licences, quality, neighbours, warc,
           alignment, variants, sharding]

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
