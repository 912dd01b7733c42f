"""Dirty views: SQL text that means the same in Spark and in the checking engine.

The supplied tables have no missing values and no broken keys, so the checks run on views that add
typical faults to every n-th key. All rows of the table are kept.
"""

CUSTOMERS = """
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 37 = 0 THEN '  '
       WHEN c_custkey % 23 = 0 THEN upper(c_name) WHEN c_custkey % 29 = 0 THEN concat(' ', c_name, ' ')
       ELSE c_name END AS name,
  CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN ''
       WHEN c_custkey % 29 = 0 THEN concat('user ', cast(c_custkey AS string), '@mail.com')
       WHEN c_custkey % 23 = 0 THEN concat('user', cast(c_custkey AS string), '.mail.com')
       WHEN c_custkey % 19 = 0 THEN concat('user', cast(c_custkey AS string), '@@mail.com')
       WHEN c_custkey % 17 = 0 THEN '@mail.com'
       WHEN c_custkey % 13 = 0 THEN concat('user', cast(c_custkey AS string), '@')
       WHEN c_custkey % 11 = 0 THEN concat('user', cast(c_custkey AS string), '@mailcom')
       WHEN c_custkey % 43 = 0 THEN concat('us..er', cast(c_custkey AS string), '@mail..com')
       WHEN c_custkey % 7 = 0 THEN concat('garcía.peña', cast(c_custkey AS string), '@mail.com')
       WHEN c_custkey % 47 = 0 THEN concat('user!', cast(c_custkey AS string), '@mail.com')
       ELSE concat('user', cast(c_custkey AS string), '@mail.com') END AS email,
  CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN ' '
       WHEN c_custkey % 31 = 0 THEN concat('tel ', cast(c_custkey AS string))
       WHEN c_custkey % 29 = 0 THEN concat('9', lpad(cast(c_custkey AS string), 8, '0'), '#1')
       WHEN c_custkey % 23 = 0 THEN cast(c_custkey AS string)
       WHEN c_custkey % 19 = 0 THEN concat('+51 (01) 9', lpad(cast(c_custkey AS string), 8, '0'))
       WHEN c_custkey % 13 = 0 THEN concat('+51 9', lpad(cast(c_custkey AS string), 8, '0'))
       WHEN c_custkey % 11 = 0 THEN concat('519', lpad(cast(c_custkey AS string), 8, '0'))
       ELSE concat('9', lpad(cast(c_custkey AS string), 8, '0')) END AS phone,
  CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN ''
       WHEN c_custkey % 23 = 0 THEN concat('20', lpad(cast(c_custkey AS string), 9, '0'), 'X')
       WHEN c_custkey % 19 = 0 THEN concat('20.', lpad(cast(c_custkey AS string), 8, '0'))
       WHEN c_custkey % 13 = 0 THEN concat('20-', lpad(cast(c_custkey AS string), 4, '0'), '-1')
       ELSE concat('20', lpad(cast(c_custkey AS string), 9, '0')) END AS tax_id,
  CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN ''
       WHEN c_custkey % 29 = 0 THEN concat('https://shop.example.com/a b/', cast(c_custkey AS string))
       WHEN c_custkey % 23 = 0 THEN concat('www.example.com/', cast(c_custkey AS string))
       WHEN c_custkey % 19 = 0 THEN concat('https://?', cast(c_custkey AS string))
       ELSE concat('https://shop.example.com/', cast(c_custkey AS string)) END AS website,
  CASE WHEN c_custkey % 43 = 0 THEN NULL WHEN c_custkey % 41 = 0 THEN 'N/A' WHEN c_custkey % 37 = 0 THEN '--'
       WHEN c_custkey % 13 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 17 = 0 THEN concat(c_mktsegment, ' ')
       ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN c_acctbal * 100
       WHEN c_custkey % 29 = 0 THEN -1000.0 ELSE c_acctbal END AS balance,
  CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 'unknown'
       WHEN c_custkey % 13 = 0 THEN concat('$', cast(c_custkey % 997 AS string), '.50')
       ELSE concat(cast(c_custkey % 997 AS string), '.25') END AS credit,
  CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 97 = 0 THEN 'soon'
       WHEN c_custkey % 11 = 0 THEN concat(lpad(cast(1 + c_custkey % 28 AS string), 2, '0'), '/',
            lpad(cast(1 + c_custkey % 12 AS string), 2, '0'), '/', cast(2012 + c_custkey % 15 AS string))
       WHEN c_custkey % 53 = 0 THEN concat(lpad(cast(1 + c_custkey % 28 AS string), 2, '0'), '.',
            lpad(cast(1 + c_custkey % 12 AS string), 2, '0'), '.', cast(2012 + c_custkey % 15 AS string))
       ELSE concat(cast(2012 + c_custkey % 15 AS string), '-', lpad(cast(1 + c_custkey % 12 AS string), 2, '0'), '-',
            lpad(cast(1 + c_custkey % 28 AS string), 2, '0')) END AS joined,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN cast(c_nationkey AS bigint) + 900
       ELSE cast(c_nationkey AS bigint) END AS nation
FROM customer
"""

ORDERS_D = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 17 = 0 THEN -o_totalprice WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 23 = 0 THEN 'X' WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderdate END AS placed,
  CASE WHEN o_orderkey % 37 = 0 THEN o_custkey + 1000000000 WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_custkey END AS custkey
FROM orders
"""

# Part rows with some repeated ids and missing fields, for the choice of the record to keep.
PARTS_D = """
SELECT CASE WHEN p_partkey % 50 = 0 THEN p_partkey + 1 ELSE p_partkey END AS id,
  CASE WHEN p_partkey % 27 = 0 THEN NULL ELSE concat(p_name, ' ', p_type) END AS name,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE cast(p_size AS bigint) END AS size,
  p_retailprice AS price
FROM part
"""

# Company-like names: one or more written variants of the same entity. Words come from a hash of the key.
_WORD = "translate(substr(md5(cast(p_partkey AS string)), {start}, {size}), '0123456789abcdef', 'abeilmnorstudcgp')"
COMPANIES = f"""
SELECT p_partkey * 4 AS id, p_partkey AS entity,
  CASE WHEN p_partkey % 211 = 0 THEN 'N/A' WHEN p_partkey % 199 = 0 THEN NULL
       ELSE concat({_WORD.format(start=1, size=7)}, ' ', {_WORD.format(start=8, size=9)}, ' ', p_name, ' S.A.C.') END AS name,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand
FROM part
UNION ALL
SELECT p_partkey * 4 + 1 AS id, p_partkey AS entity,
  CASE WHEN p_partkey % 2 = 0 THEN upper(concat({_WORD.format(start=1, size=7)}, ' ', {_WORD.format(start=8, size=9)}, ' ', p_name, ' SAC'))
       ELSE concat({_WORD.format(start=1, size=7)}, ' ', {_WORD.format(start=8, size=8)}, ' ', p_name, ' S.A.C.') END AS name,
  p_brand AS brand
FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')
UNION ALL
SELECT p_partkey * 4 + 2 AS id, p_partkey AS entity,
  CASE WHEN p_partkey % 3 = 0 THEN concat({_WORD.format(start=1, size=7)}, ' ', {_WORD.format(start=8, size=9)}, ' ', p_name, ' S.A.C.')
       ELSE concat({_WORD.format(start=1, size=5)}, ' ', {_WORD.format(start=8, size=9)}, ' ', p_name, ' del norte') END AS name,
  NULL AS brand
FROM part WHERE p_brand IN ('Brand#3', 'Brand#4')
"""

# A run log derived from orders: one run per order.
RUNS = """
SELECT o_orderkey AS run_id, o_custkey % 7 AS owner, o_orderdate AS run_at, o_orderpriority AS purpose,
  concat('file_', cast(o_custkey % 50 AS string), '.csv') AS file_name,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('Monthly check ', o_orderstatus) END AS description,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(o_orderkey % 101 AS double) END AS score, o_custkey * 10 AS n_rows
FROM orders
"""

# view name -> (tables or views it reads, SQL text)
DIRT = {
    "customers": (("customer",), CUSTOMERS),
    "orders_d": (("orders",), ORDERS_D),
    "parts_d": (("part",), PARTS_D),
    "companies": (("part",), COMPANIES),
    "runs": (("orders",), RUNS),
}
