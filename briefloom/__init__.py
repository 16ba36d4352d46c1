"""briefloom: project-context briefs on Spark.

Column functions (``briefloom.functions``), DataFrame operators
(``briefloom.operators``), readers and test-table adapters
(``briefloom.sources``), the inbox stream (``briefloom.streaming``), composite
jobs, registered queries and their SQL twins (``briefloom.plans``).  Every
function takes and returns DataFrames or Columns; nothing is collected to the
driver.
"""
