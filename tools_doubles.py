"""Rewrite underwrite/plans/doubles.py from the column types the oracle engine reports."""

import duckdb

from underwrite.plans import catalog

SF = "/root/testdata/sf0.001"
con = duckdb.connect()
for t in "region nation customer supplier part orders lineitem events".split():
    con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
lines = ['"""Floating-point columns of each counterpart, rounded before comparison (see tools_doubles.py)."""', "", "DOUBLE_COLUMNS: dict[str, str] = {"]
for name, query in sorted(catalog.QUERIES.items()):
    if query.sql:
        kinds = con.execute(f"describe {query.sql}").fetchall()
        names = [k[0] for k in kinds if k[1] == "DOUBLE" or k[1].startswith("DECIMAL")]
        odd = [k[:2] for k in kinds if k[1] in ("HUGEINT",) or k[1].startswith("DECIMAL")]
        if odd:
            print(name, odd)
        if names:
            lines.append(f'    "{name}": "{" ".join(names)}",')
lines.append("}")
open("underwrite/plans/doubles.py", "w").write("\n".join(lines) + "\n")
