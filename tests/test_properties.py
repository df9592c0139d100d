"""Property test: every search plan equals the plain statement of the
semantics for any files, context sizes and bucket widths."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brute import output
from conftest import lines_df
from loglens.config import LogQuery
from loglens.operators import lines as L

WORDS = ["ok", "ERROR a", "ERROR a", "noise", "warn", "ok"]

files_st = st.dictionaries(
    st.sampled_from(["/p/a.log", "/p/b.log", "/q/c.log"]),
    st.lists(st.sampled_from(WORDS), min_size=0, max_size=40),
    min_size=1, max_size=3,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(files=files_st, before=st.integers(0, 3), after=st.integers(0, 3), width=st.integers(1, 50),
       dedup=st.booleans(), plan=st.sampled_from(["bucket", "select", "join", "auto", "window"]))
def test_search_plans_equal_brute_force(spark, files, before, after, width, dedup, plan):
    df = lines_df(spark, files)
    q = LogQuery(pattern="ERROR", before=before, after=after, ignore=("noise",), dedup=dedup)
    got = sorted((r["path"], r["line_no"], r["sub"], r["line"])
                 for r in L.select_lines(df, q, plan=plan, bucket_width=width).collect())
    want = sorted((p, *row) for p, ls in files.items() for row in output(ls, "ERROR", before, after, ("noise",), dedup))
    assert got == want
