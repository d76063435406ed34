"""The smallest tables given."""

from marketlens.llm.common import table

SF = "/root/testdata/sf0.001"


def sf(spark, name):
    return table(spark, SF, name)
