"""spanloom: grounded text-corpus analytics as Spark jobs.

Documents become content-addressed chunks; chunks are ranked, related, typed,
admitted, quoted, scored and compared with DataFrame operators.  Every public
function takes and returns DataFrames (or Columns) and leaves the physical plan
to Catalyst; Python runs inside tasks only for the few kernels that walk text
or a small bounded group in order.
"""
