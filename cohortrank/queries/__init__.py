"""All registered queries and the SQL that they must agree with."""

from cohortrank.queries import availability, careers, learned, payloads, plans, profiles, relational, shapes, training, workbooks  # noqa: F401  they register their queries
from cohortrank.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
