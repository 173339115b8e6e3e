"""Common tables of the oracle SQL, and the registry."""

from __future__ import annotations

from tessera.plans.inputs import ASSIGNMENTS, CLUSTERS, EXAMPLES, FEATURES

BASE = f"""WITH examples AS ({EXAMPLES}), features AS ({FEATURES}), clusters AS ({CLUSTERS}), assignments AS ({ASSIGNMENTS}),
t AS (SELECT m, count(*) AS t_m FROM clusters GROUP BY m),
sc AS (SELECT row_idx, m, sum(freq) AS s, sum(CASE side WHEN 'C' THEN freq ELSE -freq END) AS v,
              CAST(sum(CASE WHEN freq > 0.01 THEN CASE side WHEN 'C' THEN 1 ELSE -1 END ELSE 0 END) AS BIGINT) AS u_num
       FROM features JOIN clusters USING (feature) WHERE side IN ('C', 'R') GROUP BY 1, 2),
scores AS (SELECT sc.*, t_m, u_num / CAST(t_m AS DOUBLE) AS u FROM sc JOIN t USING (m)),
n AS (SELECT count(*) AS n FROM examples)"""


def R(x: str, digits: int = 6) -> str:
    """Six decimals (or so many) without negative zero, as r6 rounds."""
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0"


def registry():
    queries, sql = {}, {}

    def add(name: str, oracle: str | None = None):
        def put(f):
            queries[name] = f
            if oracle:
                sql[name] = oracle
            return f

        return put

    return queries, sql, add
