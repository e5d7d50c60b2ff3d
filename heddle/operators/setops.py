"""Set operations."""

from __future__ import annotations

from .registry import sql_query as q

_A = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 8000"
_B = "SELECT s_nationkey AS k FROM supplier"

for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    q(f"set_{_name}", f"{_A} {_op} {_B}")
q("set_nulls", "SELECT nullif(n_regionkey, 1) AS k FROM nation INTERSECT SELECT nullif(r_regionkey, 1) FROM region")
q("set_precedence", "SELECT r_regionkey AS k FROM region UNION ALL SELECT n_regionkey FROM nation INTERSECT SELECT 3")
q("set_order_limit", f"SELECT k FROM ({_A} UNION {_B}) t ORDER BY k DESC LIMIT 6")
q("set_with", f"WITH a AS ({_A}), b AS ({_B}) SELECT k FROM a EXCEPT SELECT k FROM b")
