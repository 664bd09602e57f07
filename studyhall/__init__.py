"""studyhall — tutoring-marketplace analytics as Spark DataFrame operators.

Entry points:
  studyhall.session.build_session / configure      session settings (UTC, AQE, checkpoint folder)
  studyhall.sources.tables.load_tables             stored domain tables with fixed schemas
  studyhall.sources.fixtures.Fixtures              domain tables derived from the test-data tables
  studyhall.plans.*                                 named queries (admin, wallet, discovery, rooms, teacher, center, views)
  studyhall.jobs.*                                  decision and maintenance jobs over tables of requests
  studyhall.streaming.streams                       Structured Streaming jobs
Every operator takes ``t`` (a mapping table name -> DataFrame) and returns a DataFrame.
"""

__version__ = "0.1.0"
