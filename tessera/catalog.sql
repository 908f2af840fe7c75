-- The snippets of the registered queries. Each runs with fixtures in the place of the tables that it names.

WITH spending AS (
  -- @tag(spending)
  SELECT custkey, count(*) AS n_orders, sum(cents) AS spent
  FROM sales
  GROUP BY custkey
),
fees AS (
  /* @tag(fees) */
  SELECT orderkey, custkey, cents, cents + 250 AS with_fee
  FROM sales
),
home AS (
  SELECT nationkey, nation FROM places
)
-- @tag(customer_report)
SELECT c.custkey, c.name, s.n_orders, s.spent, h.nation, v.perk
FROM clients AS c
LEFT JOIN spending s ON s.custkey = c.custkey
LEFT JOIN home h ON h.nationkey = c.nationkey
LEFT JOIN (VALUES ('BUILDING', 'tools'), ('MACHINERY', 'oil')) v(segment, perk) ON v.segment = c.segment;

-- @tag(segment_letters)
SELECT segment, length(segment) AS letters
FROM ( -- @tag(segments)
  SELECT DISTINCT segment FROM clients
);

-- @tag(neighbours)
SELECT a.suppkey, a.name, b.suppkey AS next_key, b.name AS next_name
FROM suppliers a JOIN suppliers AS b ON b.suppkey = a.suppkey + 1;

-- @tag(nested)
SELECT custkey, array(nationkey::smallint, 7S) AS l, map('n', nationkey::smallint) AS m,
       named_struct('x', nationkey, 'y', name) AS s, nationkey::bigint AS i, TIMESTAMP_NTZ '2024-02-29 12:30:00' AS t
FROM clients;

-- @tag(every_supplier)
SELECT * FROM supplier;

-- @tag(moved_suppliers)
SELECT s_suppkey, s_name, s_nationkey + 1 AS s_nationkey, s_acctbal FROM supplier
