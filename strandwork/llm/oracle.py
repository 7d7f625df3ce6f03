"""SQL of the corpus queries, where SQL can say what they return: written apart from the operators, for DuckDB."""

from __future__ import annotations

from . import mixing, quality, sharding

WORDS = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_VOTES = "[" + ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for bad, good in quality.RULES.values()) + "]"
_RULES = len(quality.RULES)
_K = "list_transform(range(1, len(ps)+1), lambda k: {x})"
_RATE = "list_transform(range(1, " + str(_RULES + 1) + "), lambda j: (1+list_sum(list_transform(range(1, len(ps)+1), lambda k: CASE WHEN ps[k].v[j]=-1 THEN ps[k].n*{w} ELSE 0 END)))/(2+list_sum(list_transform(range(1, len(ps)+1), lambda k: CASE WHEN ps[k].v[j]<>0 THEN ps[k].n*{w} ELSE 0 END))))"
_ODDS = f"ln(share)-ln(1-share)+list_sum(list_transform(range(1, {_RULES + 1}), lambda j: CASE ps[k].v[j] WHEN -1 THEN ln(ga[j])-ln(ba[j]) WHEN 1 THEN ln(1-ga[j])-ln(1-ba[j]) ELSE 0 END))"

OP8 = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text,'') AS t, row_number() OVER () AS r FROM documents),
 w AS (SELECT doc_id, r, t, {WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
 win AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS x FROM (SELECT r, ws, unnest(range(1, len(ws)-1)) AS i FROM w)),
 hit AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
 rep AS (SELECT r, count(DISTINCT i+k) AS n FROM hit, range(0,3) s(k) GROUP BY r),
 c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws,''))::BIGINT AS word_chars, len(regexp_extract_all(t,'[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls)-len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n,0)::BIGINT AS n_repeat_words,
  len(ls) AS n_lines, len(list_distinct(ws)) AS n_distinct_words, len(list_filter(ws, lambda w: right(w,1) IN ('.','!','?','…'))) AS n_ends, len(regexp_extract_all(t,'\p{{Lu}}')) AS n_upper,
  len(list_filter(ws, lambda w: regexp_matches(w,'[#*$%&|<>]'))) AS n_symbol_words, len(list_filter(ws, lambda w: NOT regexp_matches(w,'\p{{L}}'))) AS n_bare_words FROM w LEFT JOIN rep USING (r)),
 v AS (SELECT *, {quality.BASE_FAILED} AS base_failed, {_VOTES} AS v FROM c),
 p AS (SELECT list({{'v': v, 'n': n}}) AS ps FROM (SELECT v, count(*)::DOUBLE AS n FROM v WHERE NOT base_failed GROUP BY v)),
 em AS (SELECT 0 AS it, ps, {_K.format(x="(1+len(list_filter(ps[k].v, lambda y: y=1)))/(2+len(list_filter(ps[k].v, lambda y: y<>0)))::DOUBLE")} AS q FROM p
  UNION ALL SELECT it+1, ps, {_K.format(x=f"1/(1+exp(-({_ODDS})))")} FROM (SELECT it, ps, (1+list_sum({_K.format(x='ps[k].n*q[k]')}))/(2+list_sum({_K.format(x='ps[k].n')})) AS share, {_RATE.format(w='q[k]')} AS ga, {_RATE.format(w='(1-q[k])')} AS ba FROM em WHERE it<{quality.ROUNDS + 1})),
 f AS (SELECT ps[k].v AS v, q[k] AS good FROM (SELECT ps, q, unnest(range(1, len(ps)+1)) AS k FROM em WHERE it={quality.ROUNDS + 1}))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(good >= {quality.KEEP_AT}, false) AS kept FROM v LEFT JOIN f USING (v)"""

OP9 = rf"""WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT doc_id, {WORDS} AS ws FROM d),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws)=0 THEN [] WHEN len(ws)<4 THEN [array_to_string(ws,' ')] ELSE list_transform(range(1, len(ws)-2), lambda i: array_to_string(ws[i:i+3],' ')) END) AS x FROM w),
 sets AS (SELECT min(doc_id) AS id, list_sort(x) AS x, len(x) AS n FROM s WHERE len(x)>0 GROUP BY list_sort(x), len(x)),
 tok AS (SELECT id, n, hash(unnest(x)) AS h FROM sets),
 link AS (SELECT a.id AS a, b.id AS b FROM tok a JOIN tok b ON a.h=b.h AND a.id<b.id AND 100*least(a.n,b.n)>=85*greatest(a.n,b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100*count(*)>=85*(a.n+b.n-count(*))),
 edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach AS (SELECT a AS id, a AS far FROM edge UNION SELECT reach.id, edge.b FROM reach JOIN edge ON reach.far=edge.a),
 label AS (SELECT id, min(far) AS label FROM reach GROUP BY id)
 SELECT doc_id, len(s.x)::BIGINT AS n_shingles, coalesce(label, id, doc_id) AS component_id FROM s LEFT JOIN sets ON list_sort(s.x)=sets.x LEFT JOIN label USING (id)"""

_WEIGHTS = "[" + ",".join(f"{w}e0" for w in mixing.WEIGHTS) + "]"
_HASH = "CAST(('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR,'')),1,15)) AS BIGINT)"

OP6 = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source,chr(1114111)) AS s, source, len({WORDS.replace('(t,', "(coalesce(text,''),")})::BIGINT AS size FROM documents),
 o AS (SELECT source, s, sum(size)::BIGINT AS n, {_WEIGHTS}[1 + (row_number() OVER (ORDER BY source IS NULL, encode(s)) - 1) % {len(mixing.WEIGHTS)}] AS w FROM d GROUP BY source, s),
 fill AS (SELECT {mixing.SHARE}*(SELECT sum(n) FROM o) AS rest, (SELECT sum(w) FROM o) AS total, (SELECT list({{'s': s, 'w': w, 'most': {mixing.MOST}*n}}) FROM o) AS open, []::VARCHAR[] AS done
  UNION ALL SELECT rest - list_sum(list_transform(over, lambda x: x.most)), total - list_sum(list_transform(over, lambda x: x.w)), list_filter(open, lambda x: NOT rest*x.w > x.most*total), list_concat(done, list_transform(over, lambda x: x.s))
  FROM (SELECT *, list_filter(open, lambda x: rest*x.w > x.most*total) AS over FROM fill) WHERE len(over)>0 AND len(open)>len(over)),
 last AS (SELECT * FROM fill ORDER BY len(done) DESC LIMIT 1),
 t AS (SELECT o.*, CASE WHEN list_contains(done, o.s) OR rest*w > {mixing.MOST}*n*total THEN {mixing.MOST}.0*n ELSE rest*w/total END AS target FROM o, last),
 u AS (SELECT *, least({mixing.MOST}*n, round_even(target,0))::BIGINT AS words FROM t),
 p AS (SELECT doc_id, s, size, n, target, words, sum(size) OVER (PARTITION BY s ORDER BY {_HASH.format(seed=mixing.SEED)}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d JOIN u USING (s)),
 cnt AS (SELECT s, (words + {mixing.BLOCK - 1})//{mixing.BLOCK} AS c, sum((words + {mixing.BLOCK - 1})//{mixing.BLOCK}) OVER (ORDER BY source IS NULL, encode(s)) AS upto FROM u),
 all_slots AS (SELECT greatest(1, length(bin((SELECT sum(c) FROM cnt)::BIGINT - 1))) AS bits, unnest(range(0, (SELECT sum(c) FROM cnt)::BIGINT)) AS slot),
 points AS (SELECT slot, row_number() OVER (ORDER BY reverse(lpad(bin(slot), bits::INT, '0'))) - 1 AS rank FROM all_slots),
 places AS (SELECT s, slot, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS k FROM points JOIN cnt ON rank >= upto - c AND rank < upto)
 SELECT doc_id, size, n AS source_size, round(target,6) AS target, (size*(words//greatest(n,1)) + greatest(0, least(size, words%greatest(n,1) - start)))::BIGINT AS taken, slot, CASE WHEN slot IS NOT NULL THEN (start % {mixing.BLOCK})::BIGINT END AS "offset"
 FROM p LEFT JOIN places ON places.s = p.s AND size > 0 AND start < words AND k = start // {mixing.BLOCK}"""

_ATOM = "CAST(('0x' || substr(sha256(t),1,15)) AS BIGINT)"
_WALK = "list_reduce(list_transform(sizes, lambda x: {{'k': 0::BIGINT, 'h': x}}), lambda a, x: CASE WHEN a.h + x.h > {c} THEN {{'k': a.k + 1, 'h': x.h}} ELSE {{'k': a.k, 'h': a.h + x.h}} END).k"

#: crc32 by its table, a byte at a time.
_TABLE = "(SELECT list(list_reduce(list_concat([i], [0,0,0,0,0,0,0,0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(0, 256) t(i))"
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295::BIGINT)"

OP4 = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text,'') AS t FROM documents), r AS (SELECT doc_id, {_CRC} AS text_crc32, (strlen(t) + {sharding.ROW_BYTES})::BIGINT AS size, {_ATOM} AS key FROM d, {_TABLE}),
 a AS (SELECT key, sum(size)::BIGINT AS size FROM r GROUP BY key), l AS (SELECT list(size ORDER BY key) AS sizes, max(size) AS top, sum(size)::BIGINT AS total FROM a),
 b AS (SELECT top AS low, total AS high, sizes FROM l UNION ALL SELECT CASE WHEN ok THEN low ELSE mid+1 END, CASE WHEN ok THEN mid ELSE high END, sizes FROM (SELECT *, (low+high)//2 AS mid, {_WALK.format(c='(low+high)//2')} < {sharding.SHARDS} AS ok FROM b WHERE low<high)),
 cap AS (SELECT low AS c FROM b WHERE low=high LIMIT 1), e AS (SELECT key, sum(size) OVER (ORDER BY key) AS upto FROM a),
 cut AS (SELECT 0 AS shard, (SELECT max(upto) FROM e WHERE upto <= (SELECT c FROM cap)) AS upto, 0::HUGEINT AS since UNION ALL SELECT shard+1, (SELECT max(e.upto) FROM e WHERE e.upto <= cut.upto + (SELECT c FROM cap)), cut.upto FROM cut WHERE cut.upto < (SELECT total FROM l)),
 s AS (SELECT key, shard FROM e JOIN cut ON e.upto > cut.since AND e.upto <= cut.upto)
 SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY {_HASH.format(seed=4)}, doc_id, key) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM r JOIN s USING (key)"""
