-- The results of the audit relations in DuckDB's SQL, written apart from the operators, which use the DataFrame API.
-- Each part is one relation, which may name others; the derived inputs come first.

-- name: log
SELECT sample_id, model_name, concat('c', CASE WHEN shifted THEN (t + 1) % 4 ELSE t END) AS predicted_class, confidence,
  CASE WHEN r = 0 THEN 'clean' WHEN k = 0 THEN 'gaussian_blur' WHEN k = 1 THEN 'high_contrast' ELSE 'gaussian_noise' END AS perturbation_type,
  CASE r WHEN 0 THEN 'clean' WHEN 1 THEN 'mild' WHEN 2 THEN 'moderate' ELSE 'severe' END AS severity_level, concat('c', t) AS true_label, seq,
  CASE odd WHEN 1 THEN [confidence, 0.5e0] WHEN 2 THEN [-0.1e0, confidence, 'nan'::DOUBLE, 0.25e0] WHEN 3 THEN [0e0, 0e0] WHEN 4 THEN [0.1e0, 0.2e0, 0.3e0, 0.4e0] END AS probabilities
FROM (
  SELECT concat('s', l_partkey) AS sample_id, concat('m', l_suppkey % 4) AS model_name, l_partkey % 4 AS t, l_linenumber % 4 AS r, l_orderkey % 3 AS k, l_orderkey % 7 AS odd,
    round(0.3e0 + l_quantity / 80.0e0, 4) AS confidence,
    round(100 * l_discount) >= 10 - greatest(l_linenumber % 4 - 1, 0) AND (l_linenumber % 4 > 0 OR CAST(l_quantity AS INT) % 4 = 0) AS shifted,
    concat(lpad(l_orderkey::VARCHAR, 14, '0'), lpad(l_linenumber::VARCHAR, 4, '0'), lpad(l_suppkey::VARCHAR, 12, '0'), lpad(CAST(l_quantity AS INT)::VARCHAR, 6, '0'), lpad(CAST(round(l_extendedprice * 100) AS BIGINT)::VARCHAR, 14, '0')) AS seq
  FROM lineitem) d

-- name: base
SELECT *
FROM log
WHERE severity_level IN ('clean', 'none', 'original')

-- name: deduped
SELECT sample_id, model_name, min_by(predicted_class, seq) FILTER (WHERE predicted_class IS NOT NULL) AS predicted_class,
  min_by(confidence, seq) FILTER (WHERE confidence IS NOT NULL) AS confidence
FROM base
GROUP BY sample_id, model_name

-- name: a1_agreement_matrix
WITH m AS (SELECT DISTINCT model_name FROM base),
d AS (SELECT sample_id, model_name, predicted_class FROM deduped WHERE predicted_class IS NOT NULL)
SELECT a.model_name AS model_a, b.model_name AS model_b,
  CASE WHEN a.model_name = b.model_name THEN 100e0 ELSE round(100e0 * count(*) FILTER (WHERE x.predicted_class = y.predicted_class) / nullif(count(y.sample_id), 0), 6) END AS agreement_pct,
  count(y.sample_id) AS n_common
FROM m a CROSS JOIN m b LEFT JOIN d x ON x.model_name = a.model_name LEFT JOIN d y ON y.model_name = b.model_name AND y.sample_id = x.sample_id
GROUP BY a.model_name, b.model_name

-- name: s9_agreement_pairs
SELECT model_a, model_b, round(agreement_pct, 2) AS agreement_pct FROM a1_agreement_matrix

-- name: complete
SELECT sample_id, count(DISTINCT predicted_class) AS n_classes
FROM deduped
WHERE predicted_class IS NOT NULL
GROUP BY sample_id
HAVING count(DISTINCT model_name) = (SELECT count(DISTINCT model_name)
FROM base)

-- name: a2_disagreement_statistics
SELECT count(*) AS total_samples, count(*) FILTER (WHERE n_classes = 1) AS agreement_count,
  count(*) FILTER (WHERE n_classes > 1) AS disagreement_count,
  round(count(*) FILTER (WHERE n_classes = 1) / CAST(count(*) AS DOUBLE), 6) AS agreement_rate,
  round(count(*) FILTER (WHERE n_classes > 1) / CAST(count(*) AS DOUBLE), 6) AS disagreement_rate,
  (SELECT count(DISTINCT model_name)
FROM base) AS n_models
FROM complete

-- name: a2_samples_by_model
SELECT model_name, count(DISTINCT sample_id) AS samples
FROM base
GROUP BY model_name

-- name: a3_disagreements
SELECT b.sample_id, b.model_name, b.predicted_class, b.confidence
FROM base b
WHERE b.sample_id IN (SELECT sample_id
FROM complete
WHERE n_classes > 1)

-- name: class_pairs
SELECT a.model_name AS model_a, b.model_name AS model_b, a.predicted_class AS class_a, b.predicted_class AS class_b, count(*) AS n
FROM deduped a JOIN deduped b ON a.sample_id = b.sample_id AND a.model_name < b.model_name
WHERE a.predicted_class IS NOT NULL AND b.predicted_class IS NOT NULL
GROUP BY a.model_name, b.model_name, a.predicted_class, b.predicted_class

-- name: kappa_observed
SELECT model_a, model_b, CAST(sum(n) AS DOUBLE) AS total,
  CAST(sum(CASE WHEN class_a = class_b THEN n ELSE 0 END) AS DOUBLE) AS same
FROM class_pairs
GROUP BY model_a, model_b

-- name: kappa_rows
SELECT model_a, model_b, class_a, sum(n) AS row_total
FROM class_pairs
GROUP BY model_a, model_b, class_a

-- name: kappa_columns
SELECT model_a, model_b, class_b, sum(n) AS column_total
FROM class_pairs
GROUP BY model_a, model_b, class_b

-- name: kappa_expected
SELECT r.model_a, r.model_b, CAST(sum(r.row_total * c.column_total) AS DOUBLE) AS crossed
FROM kappa_rows r JOIN kappa_columns c ON r.model_a = c.model_a AND r.model_b = c.model_b AND r.class_a = c.class_b
GROUP BY r.model_a, r.model_b

-- name: a4_cohen_kappa
SELECT o.model_a, o.model_b, round(o.same / o.total, 6) AS observed, round(e.crossed / (o.total * o.total), 6) AS expected,
  round((o.same / o.total - e.crossed / (o.total * o.total)) / nullif(1e0 - e.crossed / (o.total * o.total), 0e0), 6) AS kappa
FROM kappa_observed o JOIN kappa_expected e ON o.model_a = e.model_a AND o.model_b = e.model_b

-- name: fleiss_counts
SELECT d.sample_id, d.predicted_class, count(*) AS n
FROM deduped d JOIN complete c ON d.sample_id = c.sample_id
GROUP BY d.sample_id, d.predicted_class

-- name: fleiss_samples
SELECT sample_id, sum(n * n) AS squares, sum(n) AS raters
FROM fleiss_counts
GROUP BY sample_id

-- name: fleiss_observed
SELECT avg((squares - raters) / CAST(raters * (raters - 1) AS DOUBLE)) AS observed
FROM fleiss_samples

-- name: fleiss_classes
SELECT predicted_class, CAST(sum(n) AS DOUBLE) AS n
FROM fleiss_counts
GROUP BY predicted_class

-- name: fleiss_expected
SELECT sum(n * n) / (sum(n) * sum(n)) AS expected
FROM fleiss_classes

-- name: a5_fleiss_kappa
SELECT round(observed, 6) AS observed, round(expected, 6) AS expected, round((observed - expected) / nullif(1e0 - expected, 0e0),
  6) AS kappa
FROM fleiss_observed
CROSS JOIN fleiss_expected

-- name: a6_confidence_gaps
SELECT sample_id, round(min(confidence), 6) AS confidence_min, round(max(confidence), 6) AS confidence_max,
  round(avg(confidence) + 1e-9, 6) AS confidence_mean, round(max(confidence) - min(confidence), 6) AS confidence_gap,
  count(DISTINCT model_name) AS n_models, count(DISTINCT predicted_class) = 1 AS all_agree
FROM base
GROUP BY sample_id
HAVING count(*) >= 2 AND count(confidence) >= 1

-- name: pairs
SELECT a.sample_id, a.model_name AS model_a, b.model_name AS model_b, a.predicted_class AS class_a, b.predicted_class AS class_b,
  a.confidence AS confidence_a, b.confidence AS confidence_b, round(abs(a.confidence - b.confidence), 6) AS confidence_diff,
  a.predicted_class = b.predicted_class AS classes_agree
FROM deduped a JOIN deduped b ON a.sample_id = b.sample_id AND a.model_name < b.model_name
WHERE a.predicted_class IS NOT NULL AND b.predicted_class IS NOT NULL AND a.confidence IS NOT NULL AND b.confidence IS NOT NULL

-- name: a7_spread_summary
SELECT round(avg(confidence_diff), 6) AS mean_diff, round(max(confidence_diff), 6) AS max_diff, round(median(confidence_diff),
  6) AS median_diff, round(avg(CASE WHEN classes_agree THEN confidence_diff END), 6) AS mean_diff_agree,
  round(avg(CASE WHEN NOT classes_agree THEN confidence_diff END), 6) AS mean_diff_disagree, count(*) AS pairs,
  count(*) FILTER (WHERE classes_agree) AS agree_pairs, count(*) FILTER (WHERE NOT classes_agree) AS disagree_pairs
FROM pairs

-- name: p9_scored_pairs
SELECT *, round(least(1e0, greatest(0e0, CASE WHEN classes_agree THEN 0.3e0 ELSE 1e0 END * (CASE WHEN classes_agree THEN 0e0 ELSE
  0.5e0 END + 0.5e0 * (0.6e0 * confidence_diff + 0.4e0 * CASE WHEN classes_agree THEN 1e0 - (confidence_a + confidence_b) / 2e0
  ELSE (confidence_a + confidence_b) / 2e0 END)))), 6) AS disagreement_score,
  CASE WHEN classes_agree THEN 'low' WHEN confidence_a >= 0.8e0 AND confidence_b >= 0.8e0 THEN 'critical' WHEN confidence_a >=
  0.5e0 AND confidence_b >= 0.5e0 THEN 'high' ELSE 'moderate' END AS severity
FROM pairs

-- name: a8_score_summary
SELECT round(avg(disagreement_score), 6) AS mean_score, max(disagreement_score) AS max_score,
  min(disagreement_score) AS min_score, round(median(disagreement_score), 6) AS median_score, count(*) AS pairs
FROM p9_scored_pairs

-- name: a9_sample_severity
SELECT sample_id, CASE max(CASE severity WHEN 'low' THEN 0 WHEN 'moderate' THEN 1 WHEN 'high' THEN 2 ELSE 3 END) WHEN 0 THEN
  'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
  count(*) FILTER (WHERE severity = 'low') AS low_pairs, count(*) FILTER (WHERE severity = 'moderate') AS moderate_pairs,
  count(*) FILTER (WHERE severity = 'high') AS high_pairs, count(*) FILTER (WHERE severity = 'critical') AS critical_pairs
FROM p9_scored_pairs
GROUP BY sample_id

-- name: a10_severity_summary
SELECT s.severity, count(p.severity) AS pairs, round(coalesce(count(p.severity) / nullif((SELECT count(*) FROM p9_scored_pairs), 0)::DOUBLE, 0), 6) AS rate
FROM (SELECT unnest(['low', 'moderate', 'high', 'critical']) AS severity) s LEFT JOIN p9_scored_pairs p ON p.severity = s.severity GROUP BY s.severity

-- name: a10_critical_samples
SELECT DISTINCT sample_id, severity
FROM p9_scored_pairs
WHERE severity IN ('critical', 'high')

-- name: ranked
SELECT *, CASE WHEN severity_level IN ('clean', 'none', 'original') THEN 0 WHEN severity_level IN ('mild', 'low',
  'light') THEN 1 WHEN severity_level IN ('moderate', 'medium', 'mid') THEN 2 WHEN severity_level IN ('severe', 'high',
  'heavy') THEN 3 WHEN severity_level IN ('extreme', 'very_high', 'critical') THEN 4 ELSE 99 END AS severity_rank
FROM log

-- name: observations
SELECT sample_id, perturbation_type, severity_level, min(severity_rank) AS severity_rank, count(DISTINCT model_name) AS n_models,
  count(DISTINCT predicted_class) AS n_classes
FROM ranked
WHERE NOT (severity_level IN ('clean', 'none', 'original'))
GROUP BY sample_id, perturbation_type, severity_level
HAVING count(DISTINCT model_name) >= 2

-- name: agreed
SELECT sample_id
FROM complete
WHERE n_classes = 1

-- name: induced_keys
SELECT o.sample_id, o.perturbation_type, o.severity_level
FROM observations o
WHERE o.n_classes > 1 AND o.sample_id IN (SELECT sample_id
FROM agreed)

-- name: j4_induced_disagreements
SELECT l.sample_id, l.model_name, l.perturbation_type, l.severity_level, l.predicted_class, l.confidence,
  true AS perturbation_induced
FROM log l JOIN induced_keys k ON l.sample_id = k.sample_id AND l.perturbation_type = k.perturbation_type AND l.severity_level =
  k.severity_level
WHERE NOT (l.severity_level IN ('clean', 'none', 'original'))

-- name: typed
SELECT sample_id, severity_level, perturbation_type, count(DISTINCT model_name) AS n_models,
  count(DISTINCT predicted_class) AS n_classes
FROM log
WHERE NOT (severity_level IN ('clean', 'none', 'original'))
GROUP BY sample_id, severity_level, perturbation_type

-- name: b1_sensitivity
SELECT perturbation_type, count(*) AS observations, count(*) FILTER (WHERE n_classes > 1) AS disagreements,
  round(count(*) FILTER (WHERE n_classes > 1) / CAST(count(*) AS DOUBLE), 6) AS disagreement_rate
FROM typed
WHERE n_models >= 2
GROUP BY perturbation_type

-- name: levels
SELECT sample_id, severity_level, min(severity_rank) AS severity_rank, count(DISTINCT predicted_class) = 1 AS models_agree,
  count(DISTINCT predicted_class) AS n_unique_classes
FROM ranked
GROUP BY sample_id, severity_level
HAVING count(DISTINCT model_name) >= 2

-- name: b2_severity_rates
SELECT severity_level, min(severity_rank) AS severity_rank, count(*) AS observations,
  count(*) FILTER (WHERE NOT models_agree) AS disagreements,
  round(count(*) FILTER (WHERE NOT models_agree) / CAST(count(*) AS DOUBLE), 6) AS disagreement_rate
FROM levels
GROUP BY severity_level

-- name: breaks
SELECT *, min(CASE WHEN NOT models_agree THEN concat(lpad(CAST(severity_rank AS STRING), 3, '0'),
  severity_level) END) OVER (PARTITION BY sample_id ORDER BY severity_rank,
  severity_level ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_break,
  row_number() OVER (PARTITION BY sample_id ORDER BY severity_rank, severity_level) AS step,
  lag(models_agree) OVER (PARTITION BY sample_id ORDER BY severity_rank, severity_level) AS agreed_before
FROM levels

-- name: b3_stability
SELECT sample_id, severity_level, severity_rank, models_agree, n_unique_classes,
  coalesce(first_break = concat(lpad(CAST(severity_rank AS STRING), 3, '0'), severity_level), false) AS stability_breakpoint,
  substr(first_break, 4) AS collapse_severity
FROM breaks

-- name: clean_last
SELECT sample_id, model_name, max_by(predicted_class, seq) AS clean_class, max_by(confidence, seq) AS clean_confidence
FROM log
WHERE severity_level IN ('clean', 'none', 'original')
GROUP BY sample_id, model_name

-- name: j2_against_clean
SELECT r.sample_id, r.model_name, r.perturbation_type, r.severity_level, r.severity_rank, r.predicted_class, r.confidence,
  r.true_label, c.clean_class, c.clean_confidence, coalesce(r.predicted_class <> c.clean_class, true) AS prediction_changed,
  coalesce(c.clean_confidence - r.confidence, 0e0) AS confidence_drop
FROM ranked r
LEFT JOIN clean_last c ON r.sample_id = c.sample_id AND r.model_name = c.model_name
WHERE NOT (severity_level IN ('clean', 'none', 'original'))

-- name: flips
SELECT model_name, count(*) AS perturbed, count(*) FILTER (WHERE prediction_changed) AS flips,
  count(*) FILTER (WHERE prediction_changed) / CAST(count(*) AS DOUBLE) AS flip_rate,
  round(avg(CASE WHEN prediction_changed THEN severity_rank END), 4) AS mean_flip_rank
FROM j2_against_clean
WHERE clean_class IS NOT NULL
GROUP BY model_name

-- name: top_rank
SELECT max(severity_rank) AS top_rank
FROM ranked
WHERE NOT (severity_level IN ('clean', 'none', 'original'))

-- name: b4_model_instability
SELECT model_name, perturbed, flips, round(flip_rate, 6) AS flip_rate, mean_flip_rank,
  round(CASE WHEN flips = 0 THEN 0e0 ELSE 0.4e0 * flip_rate + 0.35e0 * (1e0 - mean_flip_rank / (top_rank + 1)) * flip_rate +
  0.25e0 * flip_rate END, 6) AS instability_score
FROM flips
CROSS JOIN top_rank

-- name: sample_breaks
SELECT sample_id, count(*) AS observations, count(*) FILTER (WHERE n_classes > 1) AS breaks,
  count(*) FILTER (WHERE n_classes > 1) / CAST(count(*) AS DOUBLE) AS rate,
  min(CASE WHEN n_classes > 1 THEN severity_rank END) AS first_rank,
  count(DISTINCT CASE WHEN n_classes > 1 THEN perturbation_type END) / CAST(count(DISTINCT perturbation_type) AS DOUBLE) AS
  breadth
FROM observations
GROUP BY sample_id

-- name: b5_sample_instability
SELECT sample_id, observations, breaks, round(rate, 6) AS disagreement_rate, first_rank, round(breadth, 6) AS breadth,
  round(CASE WHEN breaks = 0 THEN 0e0 ELSE 0.4e0 * rate + 0.35e0 * (1e0 - CAST(first_rank AS DOUBLE) / (top_rank + 1)) * rate +
  0.25e0 * breadth END, 6) AS instability_score
FROM sample_breaks
CROSS JOIN top_rank

-- name: b6_model_part
SELECT round(avg(instability_score), 6) AS mean_model_instability, max(instability_score) AS max_model_instability,
  max_by(model_name, instability_score) AS worst_model
FROM b4_model_instability

-- name: b6_sample_part
SELECT round(avg(instability_score), 6) AS mean_sample_instability, max(instability_score) AS max_sample_instability,
  count(*) AS samples
FROM b5_sample_instability

-- name: b6_instability_summary
SELECT *, round((mean_model_instability + mean_sample_instability) / 2e0, 6) AS overall_instability
FROM b6_model_part
CROSS JOIN b6_sample_part

-- name: b6_top_samples
SELECT sample_id, instability_score
FROM b5_sample_instability
ORDER BY instability_score DESC, sample_id LIMIT 5

-- name: b7_steps
SELECT *, first_value(disagreement_rate) OVER w AS first_rate, last_value(disagreement_rate) OVER w AS last_rate,
  max(disagreement_rate) OVER w AS peak_rate, lag(disagreement_rate) OVER (ORDER BY severity_rank, severity_level) AS rate_before
FROM b2_severity_rates
WINDOW w AS (ORDER BY severity_rank, severity_level ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)

-- name: b7_escalation
SELECT round(max(last_rate) - max(first_rate), 6) AS delta,
  CASE WHEN max(last_rate) - max(first_rate) > 0.02e0 THEN 'increasing' WHEN max(last_rate) - max(first_rate) < -0.02e0 THEN
  'decreasing' ELSE 'stable' END AS direction, max(peak_rate) AS peak_rate,
  min(CASE WHEN disagreement_rate = peak_rate THEN severity_level END) AS peak_severity,
  bool_and(coalesce(disagreement_rate >= rate_before, true)) AS monotonic
FROM b7_steps

-- name: b7_models
SELECT model_name, instability_score, row_number() OVER (ORDER BY instability_score DESC, model_name) AS place,
  round(max(instability_score) OVER () - min(instability_score) OVER (), 6) AS spread
FROM b4_model_instability

-- name: b7_perturbations
SELECT perturbation_type, disagreement_rate, row_number() OVER (ORDER BY disagreement_rate DESC, perturbation_type) AS place,
  round(max(disagreement_rate) OVER () - min(disagreement_rate) OVER (), 6) AS spread
FROM b1_sensitivity

-- name: b8_flip_rates
WITH f AS (SELECT perturbation_type, model_name, avg(prediction_changed::INT) AS flip_rate, avg(confidence_drop) AS mean_drop FROM j2_against_clean GROUP BY ALL)
SELECT t.perturbation_type, m.model_name, round(coalesce(f.flip_rate, 0), 6) AS flip_rate, round(coalesce(f.mean_drop, 0), 6) AS mean_drop,
  coalesce(nullif(list_position(['original', 'bright', 'dark', 'high_contrast', 'low_contrast', 'gaussian_noise', 'gaussian_blur', 'stain_shift', 'defocus_blur', 'jpeg_compression'], t.perturbation_type), 0), 11)::INT AS type_order
FROM (SELECT DISTINCT perturbation_type FROM f) t CROSS JOIN (SELECT DISTINCT model_name FROM f) m LEFT JOIN f USING (perturbation_type, model_name)

-- name: b9_instability_metrics
SELECT model_name, round(avg(CASE WHEN prediction_changed THEN 1e0 ELSE 0e0 END), 6) AS flip_rate, round(avg(confidence_drop),
  6) AS mean_drop, round(max(confidence_drop), 6) AS max_drop, round(coalesce(stddev_samp(confidence), 0e0),
  6) AS confidence_std, count(*) AS observations
FROM j2_against_clean
GROUP BY model_name

-- name: b10_accuracy
SELECT model_name, perturbation_type, round(100 * avg(CASE WHEN predicted_class = true_label THEN 1e0 ELSE 0e0 END),
  6) AS accuracy_pct, round(avg(confidence), 6) AS mean_confidence, count(*) AS n
FROM log
GROUP BY model_name, perturbation_type

-- name: b10_by_class
SELECT predicted_class, perturbation_type, round(avg(confidence), 6) AS mean_confidence, count(*) AS n
FROM log
GROUP BY predicted_class, perturbation_type

-- name: given_vectors
SELECT *, coalesce(probabilities, list_transform(range(4), lambda i: CASE WHEN i = substr(predicted_class, 2)::INT THEN confidence ELSE (1 - confidence) / 3 END)) AS v FROM log

-- name: p6_filled
SELECT model_name, severity_level, (i - 1)::INT AS k, count(*) AS n, round(avg(v[i]), 6) AS mean_probability FROM given_vectors, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL

-- name: sound_vectors
WITH h AS (SELECT *, list_transform(list_filter(v, lambda x: isfinite(x)), lambda x: greatest(x, 0)) AS held FROM given_vectors),
t AS (SELECT *, coalesce(list_sum(held), 0) AS total FROM h)
SELECT *, CASE WHEN total <= 0 THEN 'confidence_proxy' WHEN abs(total - 1) <= 1e-6 THEN 'valid' ELSE 'normalized' END AS status,
  CASE WHEN total <= 0 THEN [least(1, greatest(0, confidence)), 1 - least(1, greatest(0, confidence))] WHEN abs(total - 1) <= 1e-6 THEN held ELSE list_transform(held, lambda x: x / total) END AS p FROM t

-- name: measures
WITH e AS (SELECT *, list_sum(list_transform(p, lambda x: -least(1, greatest(x, 1e-12)) * ln(least(1, greatest(x, 1e-12))))) AS h, list_max(p) AS top, list_min(p) AS bottom, len(p) AS size FROM sound_vectors)
SELECT sample_id, model_name, perturbation_type, severity_level, seq, confidence, status, round(h, 6) AS entropy, round(least(1, greatest(0, h / ln(size))), 6) AS u, round(top, 6) AS peak, round(list_var_pop(p), 6) AS variance, round(list_stddev_pop(p), 6) AS std,
  round(top - bottom, 6) AS spread, size, round(list_sum(p), 6) AS total, round(1 - top, 6) AS flatness, round(top - list_reverse_sort(p)[2], 6) AS top2_gap, CASE WHEN top >= 0.75 THEN 'peaked' WHEN top >= 0.5 THEN 'balanced' ELSE 'flat' END AS shape,
  severity_level IN ('clean', 'none', 'original', 'baseline') AS clean, CASE severity_level WHEN 'clean' THEN 0 WHEN 'moderate' THEN 3 ELSE 99 END AS k FROM e

-- name: p5_status
SELECT status, count(*) AS n, round(avg(total), 6) AS mean_total, max(size)::INT AS most_classes FROM measures GROUP BY status

-- name: p7_entropy
SELECT sample_id, model_name, count(*) AS n, round(avg(entropy) + 1e-9, 6) AS entropy, round(avg(u) + 1e-9, 6) AS uncertainty_score, round(avg(peak) + 1e-9, 6) AS peak, round(avg(variance) + 1e-9, 6) AS variance, round(avg(std) + 1e-9, 6) AS std, round(avg(spread) + 1e-9, 6) AS spread,
  round(avg(total) + 1e-9, 6) AS total, count(*) FILTER (WHERE status = 'confidence_proxy') AS proxies FROM measures GROUP BY ALL

-- name: p8_dispersion
SELECT sample_id, model_name, round(avg(peak) + 1e-9, 6) AS concentration, round(avg(flatness) + 1e-9, 6) AS flatness, round(avg(top2_gap) + 1e-9, 6) AS top2_gap, round(avg(variance) + 1e-9, 6) AS variance, round(avg(spread) + 1e-9, 6) AS spread,
  count(*) FILTER (WHERE shape = 'peaked') AS peaked, count(*) FILTER (WHERE shape = 'balanced') AS balanced, count(*) FILTER (WHERE shape = 'flat') AS flat FROM measures GROUP BY ALL

-- name: u1_entropy_summary
SELECT count(*) AS n, round(avg(entropy), 6) AS mean_entropy, round(avg(u), 6) AS mean_uncertainty, max(u) AS max_uncertainty, count(*) FILTER (WHERE u >= 0.6) AS high, count(*) FILTER (WHERE u >= 0.8) AS critical FROM measures

-- name: u2_sample_uncertainty
SELECT sample_id, round(avg(u) + 1e-9, 6) AS mean_uncertainty, max(u) AS max_uncertainty, min(u) AS min_uncertainty, round(avg(entropy) + 1e-9, 6) AS mean_entropy, round(avg(confidence) + 1e-9, 6) AS mean_confidence, count(*) AS observations FROM measures GROUP BY sample_id

-- name: u3_severity_curve
SELECT severity_level, count(*) AS observations, round(avg(u), 6) AS mean_uncertainty, max(u) AS max_uncertainty, min(u) AS min_uncertainty, max(k)::INT AS severity_rank FROM measures GROUP BY severity_level

-- name: u4_perturbations
WITH g AS (SELECT perturbation_type, count(*) AS observations, round(avg(u), 6) AS mean_uncertainty, max(u) AS max_uncertainty, min(u) AS min_uncertainty, round(max(u) - min(u), 6) AS spread FROM measures GROUP BY perturbation_type)
SELECT *, row_number() OVER (ORDER BY mean_uncertainty DESC, perturbation_type) AS place FROM g

-- name: u5_collapses
WITH o AS (SELECT *, row_number() OVER (PARTITION BY sample_id, model_name ORDER BY k, severity_level, seq) AS n, row_number() OVER (PARTITION BY sample_id, model_name ORDER BY clean DESC, k, severity_level, seq) AS b FROM measures),
j AS (SELECT o.*, base.u AS bu, base.confidence AS bc, o.u - base.u AS rise, base.confidence - o.confidence AS fall FROM o JOIN o base ON base.sample_id = o.sample_id AND base.model_name = o.model_name AND base.b = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY sample_id, model_name ORDER BY n) AS first FROM j WHERE rise >= 0.25 OR fall >= 0.2)
SELECT sample_id, model_name, perturbation_type AS collapse_trigger, severity_level AS collapse_severity, k AS collapse_rank, bu AS baseline_entropy, u AS collapse_entropy, round(rise, 6) AS entropy_shift, round(fall, 6) AS confidence_drop,
  concat_ws('|', CASE WHEN rise >= 0.25 THEN 'entropy_spike' END, CASE WHEN fall >= 0.2 THEN 'confidence_degradation' END) AS collapse_reason FROM f WHERE first = 1

-- name: u6_collapse_summary
SELECT count(*) AS collapses, count(DISTINCT sample_id) AS samples, count(DISTINCT model_name) AS models, round(coalesce(avg(entropy_shift), 0), 6) AS mean_shift, round(coalesce(avg(confidence_drop), 0), 6) AS mean_drop FROM u5_collapses

-- name: u6_collapse_counts
SELECT 'trigger' AS part, collapse_trigger AS name, count(*) AS n FROM u5_collapses GROUP BY 2 UNION ALL SELECT 'severity', collapse_severity, count(*) FROM u5_collapses GROUP BY 2

-- name: u7_dispersion_by_model
SELECT model_name, round(avg(peak), 6) AS mean_concentration, round(avg(top2_gap), 6) AS mean_gap, round(avg(std), 6) AS mean_std, count(*) FILTER (WHERE shape = 'flat') AS flat, count(*) FILTER (WHERE shape = 'peaked') AS peaked FROM measures GROUP BY model_name

-- name: u7_dispersion_by_sample
SELECT sample_id, round(round(avg(peak), 6) + 1e-9, 6) AS mean_concentration, round(round(avg(top2_gap), 6) + 1e-9, 6) AS mean_gap, round(round(avg(std), 6) + 1e-9, 6) AS mean_std, count(*) FILTER (WHERE shape = 'flat') AS flat, count(*) FILTER (WHERE shape = 'peaked') AS peaked FROM measures GROUP BY sample_id

-- name: u8_top_samples
SELECT sample_id, mean_uncertainty FROM u2_sample_uncertainty ORDER BY mean_uncertainty DESC, sample_id LIMIT 5

-- name: u8_levels
SELECT CASE WHEN mean_uncertainty >= 0.8 THEN 'critical' WHEN mean_uncertainty >= 0.6 THEN 'high' WHEN mean_uncertainty >= 0.35 THEN 'moderate' WHEN mean_uncertainty >= 0.15 THEN 'low' ELSE 'minimal' END AS uncertainty_level, count(*) AS samples FROM u2_sample_uncertainty GROUP BY 1

-- name: u8_summary
SELECT count(*) AS observations, round(avg(u), 6) AS mean_uncertainty, max(u) AS max_uncertainty, min(u) AS min_uncertainty, round(median(u), 6) AS median_uncertainty,
  count(*) FILTER (WHERE u >= 0.8) AS critical, count(*) FILTER (WHERE u >= 0.6 AND u < 0.8) AS high, count(*) FILTER (WHERE u >= 0.35 AND u < 0.6) AS moderate, count(*) FILTER (WHERE u >= 0.15 AND u < 0.35) AS low, count(*) FILTER (WHERE u < 0.15) AS minimal,
  (SELECT string_agg(sample_id, '|' ORDER BY mean_uncertainty DESC, sample_id) FROM u8_top_samples) AS most_uncertain FROM measures

-- name: three_signals
SELECT s.sample_id, s.mean_uncertainty AS a, (SELECT avg(disagreement_score) FROM p9_scored_pairs p WHERE p.sample_id = s.sample_id) AS b, i.instability_score AS c FROM u2_sample_uncertainty s LEFT JOIN b5_sample_instability i USING (sample_id)

-- name: u9_conflicts
WITH x AS (SELECT *, (a + coalesce(b, 0) + coalesce(c, 0)) / (1 + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) AS score, concat_ws('|', CASE WHEN b >= 0.6 THEN 'disagreement' END, CASE WHEN c >= 0.6 THEN 'instability' END, CASE WHEN a >= 0.6 THEN 'uncertainty' END) AS reason FROM three_signals)
SELECT sample_id, round(a + 1e-9, 6) AS uncertainty, round(b + 1e-9, 6) AS disagreement, round(c + 1e-9, 6) AS instability, round(score + 1e-9, 6) AS conflict_score, reason AS conflict_reason FROM x WHERE reason <> '' AND (score >= 0.65 OR contains(reason, '|'))

-- name: u10_relationship
SELECT round(coalesce(corr(a, b), 0), 6) AS uncertainty_vs_disagreement, round(coalesce(corr(a, c), 0), 6) AS uncertainty_vs_instability, round(coalesce(corr(b, c), 0), 6) AS disagreement_vs_instability,
  (SELECT count(*) FROM u9_conflicts) AS conflicts, (SELECT round(coalesce(avg(conflict_score), 0), 6) FROM u9_conflicts) AS mean_conflict_score FROM three_signals

-- name: u11_model_profiles
WITH g AS (SELECT model_name, count(*) AS n, avg(u) AS mean, max(u) AS high, min(u) AS low, stddev_pop(u) AS std, avg(u) FILTER (WHERE clean) AS c, avg(u) FILTER (WHERE NOT clean) AS p, avg(variance) AS v, avg(measures.std) AS s, avg(spread) AS w, avg(peak) AS peak FROM measures GROUP BY model_name),
f AS (SELECT model_name, count(*) AS collapses, round(avg(entropy_shift), 6) AS shift FROM u5_collapses GROUP BY model_name),
d AS (SELECT *, coalesce(p - coalesce(c, mean), 0) AS delta FROM g LEFT JOIN f USING (model_name))
SELECT model_name, n, round(mean, 6) AS mean_uncertainty, high AS max_uncertainty, low AS min_uncertainty, round(std, 6) AS std_uncertainty, round(c, 6) AS clean_uncertainty, round(p, 6) AS perturbed_uncertainty, round(delta, 6) AS uncertainty_delta,
  round(v, 6) AS mean_variance, round(s, 6) AS mean_std, round(w, 6) AS mean_spread, round(peak, 6) AS mean_concentration, coalesce(collapses, 0) AS collapses, coalesce(shift, 0) AS mean_collapse_shift,
  round(least(1, greatest(0, 0.7e0 * greatest(delta, 0) + 0.3e0 * w)), 6) AS sensitivity,
  CASE WHEN mean >= 0.8 OR delta >= 0.3 OR coalesce(collapses, 0) > 0 THEN 'highly_sensitive' WHEN mean >= 0.6 OR delta >= 0.15 THEN 'sensitive' WHEN mean >= 0.35 OR delta >= 0.08 THEN 'moderate' WHEN mean >= 0.15 THEN 'stable' ELSE 'very_stable' END AS stability_label FROM d

-- name: u11_summary
SELECT count(*) AS total_models, round(avg(mean_uncertainty), 6) AS mean_uncertainty, (SELECT model_name FROM u11_model_profiles ORDER BY mean_uncertainty, uncertainty_delta, model_name DESC LIMIT 1) AS most_stable_model,
  (SELECT model_name FROM u11_model_profiles ORDER BY mean_uncertainty DESC, uncertainty_delta DESC, model_name LIMIT 1) AS highest_uncertainty_contributor, (SELECT model_name FROM u11_model_profiles ORDER BY uncertainty_delta DESC, mean_uncertainty DESC, model_name LIMIT 1) AS fastest_deteriorating_model,
  coalesce(string_agg(model_name, '|' ORDER BY model_name) FILTER (WHERE stability_label IN ('sensitive', 'highly_sensitive')), '') AS sensitive_models FROM u11_model_profiles

-- name: u12_trend
WITH o AS (SELECT list(mean_uncertainty ORDER BY severity_rank, severity_level) AS v, max(mean_uncertainty) AS top FROM u3_severity_curve)
SELECT round(v[-1] - v[1], 6) AS delta, CASE WHEN v[-1] - v[1] > 0.02 THEN 'increasing' WHEN v[-1] - v[1] < -0.02 THEN 'decreasing' ELSE 'stable' END AS direction, top AS peak_rate, (SELECT min(severity_level) FROM u3_severity_curve WHERE mean_uncertainty = top) AS peak_severity, v = list_sort(v) AS monotonic FROM o

-- name: u12_perturbations
SELECT perturbation_type, mean_uncertainty, place, round(max(mean_uncertainty) OVER () - min(mean_uncertainty) OVER (), 6) AS spread FROM u4_perturbations

-- name: attention
SELECT concat('s', vec_id // 8) AS sample_id, concat('m', vec_id % 8 % 2) AS model_name, ['clean', 'low', 'moderate', 'high'][vec_id % 8 // 2 + 1] AS severity_level,
  CASE WHEN vec_id % 8 < 2 THEN 'clean' ELSE 'blur' END AS perturbation_type, concat('c', label % 4) AS predicted_class, CASE WHEN vec_id % 5 = 0 THEN 4 ELSE 8 END AS height, embedding AS e
FROM embeddings

-- name: grids
WITH c AS (SELECT *, list_transform(range(1, height * 8 + 1), lambda i: greatest(e[i]::DOUBLE, 0)) AS pos FROM attention),
n AS (SELECT *, list_min(pos) AS low, list_max(pos) - list_min(pos) AS wide FROM c)
SELECT sample_id, model_name, severity_level, perturbation_type, predicted_class, height, list_transform(pos, lambda x: CASE WHEN wide > 0 THEN (x - low) / wide ELSE 0 END) AS v FROM n

-- name: grid_measures
WITH s AS (SELECT *, list_sum(v) AS mass FROM grids)
SELECT *, CASE WHEN mass > 0 THEN list_sum(list_transform(range(len(v)), lambda i: v[i + 1] * (i % 8))) / mass / 7 ELSE 0.5 END AS x, CASE WHEN mass > 0 THEN list_sum(list_transform(range(len(v)), lambda i: v[i + 1] * (i // 8))) / mass / (height - 1) ELSE 0.5 END AS y,
  CASE WHEN mass > 0 THEN least(1, greatest(0, list_sum(list_transform(v, lambda a: -greatest(a / mass, 1e-12) * ln(greatest(a / mass, 1e-12)))) / ln(len(v)))) ELSE 1 END AS h,
  CASE WHEN height = 8 THEN v ELSE list_transform(range(64), lambda i: v[round_even((i // 8) * 3e0 / 7, 0)::INT * 8 + i % 8 + 1]) END AS full8 FROM s

-- name: p13_features
SELECT sample_id, model_name, severity_level, perturbation_type, 'ok' AS status, round(list_avg(v), 6) AS mean, round(list_var_pop(v), 6) AS variance, round(list_stddev_pop(v), 6) AS std, round(h, 6) AS entropy, round(list_max(v), 6) AS peak, round(list_max(v) - list_min(v), 6) AS spread,
  round(x, 6) AS center_x, round(y, 6) AS center_y, round(len(list_filter(v, lambda a: a >= mass / len(v))) / len(v)::DOUBLE, 6) AS mass_above_mean, round(len(list_filter(v, lambda a: a >= 0.5 * list_max(v))) / len(v)::DOUBLE, 6) AS active_ratio FROM grid_measures

-- name: drifted
WITH j AS (
  SELECT m.*, sqrt(pow(b.x - m.x, 2) + pow(b.y - m.y, 2)) / sqrt(2) AS displacement, least(1, greatest(0, m.h - b.h)) AS dh,
    CASE WHEN m.height = b.height THEN m.v ELSE m.full8 END AS one, CASE WHEN m.height = b.height THEN b.v ELSE b.full8 END AS two
  FROM grid_measures m JOIN grid_measures b ON b.sample_id = m.sample_id AND b.model_name = m.model_name AND b.severity_level = 'clean' AND m.severity_level <> 'clean'
), o AS (
  SELECT *, list_sum(list_transform(range(1, len(one) + 1), lambda i: abs(one[i] - two[i]))) / len(one) AS l1,
    len(list_filter(range(1, len(one) + 1), lambda i: list_max(one) > 0 AND list_max(two) > 0 AND one[i] >= 0.6 * list_max(one) AND two[i] >= 0.6 * list_max(two))) / greatest(1, len(list_filter(range(1, len(one) + 1), lambda i: (list_max(one) > 0 AND one[i] >= 0.6 * list_max(one)) OR (list_max(two) > 0 AND two[i] >= 0.6 * list_max(two)))))::DOUBLE AS overlap
  FROM j
)
SELECT *, least(1, greatest(0, 0.45e0 * displacement + 0.35e0 * (1 - overlap) + 0.2e0 * dh)) AS drift FROM o

-- name: x1_drift
SELECT sample_id, model_name, severity_level, CASE severity_level WHEN 'low' THEN 2 WHEN 'moderate' THEN 3 ELSE 4 END AS severity_rank, perturbation_type, round(drift, 6) AS drift, round(displacement, 6) AS displacement, round(overlap, 6) AS overlap, round(l1, 6) AS l1_shift, round(dh, 6) AS entropy_shift,
  drift >= 0.65 OR overlap <= 0.3 OR dh >= 0.25 AS collapsed, concat_ws('|', CASE WHEN displacement >= 0.25 THEN 'activation_displacement' END, CASE WHEN 1 - overlap >= 0.35 THEN 'overlap_reduction' END, CASE WHEN dh >= 0.25 THEN 'entropy_spike' END) AS reason FROM drifted

-- name: likened
WITH j AS (
  SELECT a.sample_id, a.severity_level, a.perturbation_type, a.model_name AS model_a, b.model_name AS model_b, a.predicted_class <> b.predicted_class AS differ, CASE WHEN a.height = b.height THEN a.v ELSE a.full8 END AS one, CASE WHEN a.height = b.height THEN b.v ELSE b.full8 END AS two
  FROM grid_measures a JOIN grid_measures b ON a.sample_id = b.sample_id AND a.severity_level = b.severity_level AND a.perturbation_type = b.perturbation_type AND a.model_name < b.model_name
), o AS (
  SELECT *, len(list_filter(range(1, len(one) + 1), lambda i: list_max(one) > 0 AND list_max(two) > 0 AND one[i] >= 0.6 * list_max(one) AND two[i] >= 0.6 * list_max(two))) / greatest(1, len(list_filter(range(1, len(one) + 1), lambda i: (list_max(one) > 0 AND one[i] >= 0.6 * list_max(one)) OR (list_max(two) > 0 AND two[i] >= 0.6 * list_max(two)))))::DOUBLE AS overlap,
    CASE WHEN list_stddev_pop(one) > 0 AND list_stddev_pop(two) > 0 THEN list_sum(list_transform(range(1, len(one) + 1), lambda i: (one[i] - list_avg(one)) * (two[i] - list_avg(two)))) / len(one) / (list_stddev_pop(one) * list_stddev_pop(two)) ELSE 0 END AS r,
    coalesce(list_sum(list_transform(range(1, len(one) + 1), lambda i: one[i] * two[i])) / nullif(sqrt(list_sum(list_transform(one, lambda x: x * x)) * list_sum(list_transform(two, lambda x: x * x))), 0), 0) AS cosine,
    list_sum(list_transform(range(1, len(one) + 1), lambda i: abs(one[i] - two[i]))) / len(one) AS mad FROM j
)
SELECT *, least(1, (overlap + greatest(r, 0) + greatest(cosine, 0)) / 3) AS likeness FROM o

-- name: x2_similarity
SELECT sample_id, severity_level, perturbation_type, model_a, model_b, round(likeness, 6) AS similarity, round(1 - likeness, 6) AS divergence, round(overlap, 6) AS overlap, round(r, 6) AS correlation, round(cosine, 6) AS cosine, round(mad, 6) AS mean_absolute_difference,
  overlap >= 0.6 AND r >= 0.4 AS same_focus, differ AND 1 - likeness >= 0.25 AS disagreement_attention FROM likened

-- name: x3_summary
SELECT count(*) AS maps, count(*) FILTER (WHERE status <> 'ok') AS invalid, round(avg(entropy), 6) AS mean_entropy, round(avg(peak), 6) AS mean_peak, round(avg(spread), 6) AS mean_spread, round(avg(active_ratio), 6) AS mean_active_ratio FROM p13_features

-- name: x3_focused_samples
WITH s AS (SELECT sample_id, round(avg(entropy) + 1e-9, 6) AS mean_entropy FROM p13_features GROUP BY sample_id),
r AS (SELECT *, row_number() OVER (ORDER BY mean_entropy, sample_id) AS low, row_number() OVER (ORDER BY mean_entropy DESC, sample_id) AS high FROM s)
SELECT sample_id, mean_entropy, 'most_focused' AS "end" FROM r WHERE low <= 5 UNION ALL SELECT sample_id, mean_entropy, 'least_focused' FROM r WHERE high <= 5

-- name: x4_stability_curve
SELECT severity_level, severity_rank, count(*) AS n, round(avg(drift), 6) AS mean_drift, round(avg(displacement), 6) AS mean_displacement, round(avg(overlap), 6) AS mean_overlap, round(avg(collapsed::INT), 6) AS collapse_rate FROM x1_drift GROUP BY ALL

-- name: x5_collapses
WITH o AS (SELECT *, row_number() OVER (PARTITION BY sample_id, model_name ORDER BY severity_rank, drift DESC, severity_level, perturbation_type) AS n FROM x1_drift WHERE collapsed)
SELECT sample_id, model_name, severity_level AS collapse_severity, severity_rank AS collapse_rank, perturbation_type AS collapse_trigger, drift, displacement, overlap, reason FROM o WHERE n = 1

-- name: x6_divergence
SELECT model_a, model_b, count(*) AS n, round(avg(divergence), 6) AS mean_divergence, max(divergence) AS max_divergence, round(avg(similarity), 6) AS mean_similarity, count(*) FILTER (WHERE disagreement_attention) AS disagreements FROM x2_similarity GROUP BY ALL

-- name: x6_consistency
SELECT count(*) AS pairs, round(avg(similarity), 6) AS mean_similarity, round(avg(overlap), 6) AS mean_overlap, count(*) FILTER (WHERE similarity >= 0.7) AS consistent, count(*) FILTER (WHERE similarity < 0.4) AS inconsistent, count(*) FILTER (WHERE same_focus) AS same_focus FROM x2_similarity

-- name: x7_drift_summary
SELECT count(*) AS n, round(avg(drift), 6) AS mean_drift, max(drift) AS max_drift, count(*) FILTER (WHERE collapsed) AS collapses, count(*) FILTER (WHERE drift >= 0.65) AS high_drift,
  (SELECT model_name FROM x1_drift GROUP BY model_name ORDER BY round(avg(drift), 6) DESC, model_name LIMIT 1) AS most_sensitive_model_name, (SELECT perturbation_type FROM x1_drift GROUP BY perturbation_type ORDER BY round(avg(drift), 6) DESC, perturbation_type LIMIT 1) AS most_sensitive_perturbation_type FROM x1_drift

-- name: x7_high_drift
SELECT sample_id, count(*) AS rows, max(drift) AS max_drift FROM x1_drift WHERE drift >= 0.65 GROUP BY sample_id

-- name: x7_relationship
WITH d AS (SELECT sample_id, avg(drift) AS d FROM x1_drift GROUP BY sample_id)
SELECT count(*) AS samples, round(coalesce(corr(d, a), 0), 6) AS drift_vs_uncertainty, round(coalesce(corr(d, b), 0), 6) AS drift_vs_disagreement, round(coalesce(corr(d, c), 0), 6) AS drift_vs_instability FROM d LEFT JOIN three_signals USING (sample_id)

-- name: records
SELECT o_orderpriority AS model_name, CASE o_custkey % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'blur' WHEN 2 THEN 'contrast' WHEN 3
  THEN 'noise' ELSE 'hue' END AS perturbation_type,
  CASE o_orderkey % 3 WHEN 0 THEN 'mild' WHEN 1 THEN 'moderate' ELSE 'severe' END AS severity_level, o_orderkey % 5 AS seed,
  (CAST(round(o_totalprice) AS BIGINT) % 1000) / 1000e0 AS robustness, (o_orderkey % 97) / 97e0 AS instability,
  (CAST(round(o_totalprice) AS BIGINT) % 89) / 89e0 AS uncertainty, (CAST(round(o_totalprice) AS BIGINT) % 71) / 71e0 AS attention_stability,
  (o_custkey % 83) / 83e0 AS consensus_reliability, ((o_orderkey + o_custkey) % 61) / 61e0 AS risk, (CAST(round(o_totalprice) AS BIGINT) % 53) / 53e0 AS attention_drift, (o_custkey % 47) / 47e0 AS disagreement_rate
FROM orders

-- name: customer_records
WITH r AS (
  SELECT o_custkey, o_custkey % 6 AS shape, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nth, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderpriority AS model_name,
    ['clean', 'blur', 'contrast', 'noise', 'hue'][o_custkey % 5 + 1] AS perturbation_type, ['mild', 'moderate', 'severe'][o_orderkey % 3 + 1] AS severity_level,
    (CAST(round(o_totalprice) AS BIGINT) % 1000) / 1000e0 AS robustness, (o_orderkey % 97) / 97e0 AS instability, (CAST(round(o_totalprice) AS BIGINT) % 89) / 89e0 AS uncertainty
  FROM orders)
SELECT *, NULL AS scope FROM r WHERE shape < 3
UNION ALL SELECT *, 'model' FROM r WHERE shape = 3
UNION ALL SELECT o_custkey, shape, n, n, model_name, perturbation_type, severity_level, robustness, instability, uncertainty, 'perturbation' FROM r WHERE shape = 3 AND nth = 0
UNION ALL SELECT o_custkey, shape, 0, n, model_name, perturbation_type, severity_level, robustness, instability, uncertainty, 'first' FROM r WHERE shape = 4 AND nth = 0
UNION ALL SELECT o_custkey, shape, 1, n, model_name, perturbation_type, severity_level, robustness, instability, uncertainty, 'last' FROM r WHERE shape = 4 AND nth = n - 1

-- name: s4_gathered
SELECT concat('experiment_', o_custkey) AS path, nth::INT AS position, scope AS benchmark_scope, model_name, perturbation_type, severity_level, robustness, instability, uncertainty, NULL::VARCHAR AS error FROM customer_records
UNION ALL SELECT DISTINCT concat('experiment_', o_custkey), -1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no JSON' FROM orders WHERE o_custkey % 6 = 5

-- name: s4_scopes
SELECT benchmark_scope, error, count(*) AS records, count(DISTINCT path) AS summaries FROM s4_gathered GROUP BY ALL

-- name: s8_disagreements
SELECT sample_id AS key, count(*) AS n, '[' || string_agg(to_json(struct_pack(model_name := model_name, predicted_class := predicted_class, confidence := confidence))::VARCHAR, ',' ORDER BY model_name, predicted_class, confidence) || ']' AS records
FROM a3_disagreements GROUP BY sample_id

-- name: s8_trust
SELECT trust_level AS key, count(*) AS n, min(sample_id) AS first, max(sample_id) AS last FROM d10_trust GROUP BY trust_level

-- name: long_metrics
SELECT model_name, perturbation_type, severity_level, unnest(['robustness', 'instability', 'uncertainty']) AS metric, unnest([robustness, instability, uncertainty]) AS x FROM records

-- name: e1_scalar_statistics
SELECT metric, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(var_pop(x), 6) AS variance, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max, round(max(x) - min(x), 6) AS spread FROM long_metrics GROUP BY metric

-- name: e2_group_statistics
SELECT model_name, perturbation_type, count(*) AS record_count, round(avg(robustness), 6) AS robustness_mean,
  round(stddev_pop(robustness), 6) AS robustness_std, round(avg(instability), 6) AS instability_mean,
  round(stddev_pop(instability), 6) AS instability_std, round(avg(uncertainty), 6) AS uncertainty_mean,
  round(stddev_pop(uncertainty), 6) AS uncertainty_std
FROM records
GROUP BY model_name, perturbation_type

-- name: e3_levels
SELECT severity_level, CASE severity_level WHEN 'mild' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END AS severity_rank, count(*) AS n, round(avg(robustness), 6) AS robustness_mean, min(robustness) AS robustness_min, max(robustness) AS robustness_max, round(avg(instability), 6) AS instability_mean,
  min(instability) AS instability_min, max(instability) AS instability_max, round(avg(uncertainty), 6) AS uncertainty_mean, min(uncertainty) AS uncertainty_min, max(uncertainty) AS uncertainty_max FROM records GROUP BY severity_level

-- name: e3_escalation
WITH m AS (SELECT metric, round(avg(x) FILTER (WHERE severity_level = 'severe'), 6) - round(avg(x) FILTER (WHERE severity_level = 'mild'), 6) AS d FROM long_metrics GROUP BY metric)
SELECT metric, round(d, 6) AS escalation, row_number() OVER (ORDER BY round(d, 6) DESC, metric) AS escalation_rank, CASE WHEN (SELECT max(d) FROM m) > 0 THEN 'increasing' ELSE 'stable' END AS trend FROM m

-- name: e4_correlations
WITH c AS (SELECT unnest(['robustness', 'robustness', 'instability']) AS metric_a, unnest(['instability', 'uncertainty', 'uncertainty']) AS metric_b, unnest([round(corr(robustness, instability), 6), round(corr(robustness, uncertainty), 6), round(corr(instability, uncertainty), 6)]) AS r FROM records)
SELECT *, row_number() OVER (ORDER BY abs(r) DESC, metric_a, metric_b) AS place, round((SELECT avg(abs(r)) FROM c), 6) AS mean_strength FROM c

-- name: e5_statistics
SELECT model_name, metric, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max FROM long_metrics GROUP BY model_name, metric

-- name: e5_model_benchmark
WITH m AS (SELECT model_name, count(*) AS n, round(avg(robustness), 6) AS robustness, round(avg(attention_stability), 6) AS attention_stability, round(avg(consensus_reliability), 6) AS consensus_reliability, round(avg(risk), 6) AS risk, round(avg(uncertainty), 6) AS uncertainty, round(avg(instability), 6) AS instability, round(avg(attention_drift), 6) AS attention_drift FROM records GROUP BY model_name)
SELECT model_name, n, robustness AS mean_robustness, attention_stability AS mean_attention_stability, consensus_reliability AS mean_consensus_reliability, risk AS mean_risk, uncertainty AS mean_uncertainty, instability AS mean_instability, attention_drift AS mean_attention_drift,
  round((coalesce((robustness - min(robustness) OVER ()) / nullif(max(robustness) OVER () - min(robustness) OVER (), 0), 1) + coalesce((attention_stability - min(attention_stability) OVER ()) / nullif(max(attention_stability) OVER () - min(attention_stability) OVER (), 0), 1) + coalesce((consensus_reliability - min(consensus_reliability) OVER ()) / nullif(max(consensus_reliability) OVER () - min(consensus_reliability) OVER (), 0), 1) + coalesce(1 - (risk - min(risk) OVER ()) / nullif(max(risk) OVER () - min(risk) OVER (), 0), 1) + coalesce(1 - (uncertainty - min(uncertainty) OVER ()) / nullif(max(uncertainty) OVER () - min(uncertainty) OVER (), 0), 1) + coalesce(1 - (instability - min(instability) OVER ()) / nullif(max(instability) OVER () - min(instability) OVER (), 0), 1) + coalesce(1 - (attention_drift - min(attention_drift) OVER ()) / nullif(max(attention_drift) OVER () - min(attention_drift) OVER (), 0), 1)) / 7, 6) AS benchmark_score FROM m

-- name: e5_leaderboards
SELECT 'benchmark_score' AS board, model_name, benchmark_score AS value, row_number() OVER (ORDER BY benchmark_score DESC, model_name) AS place FROM e5_model_benchmark
UNION ALL SELECT 'robustness', model_name, mean_robustness, row_number() OVER (ORDER BY mean_robustness DESC, model_name) FROM e5_model_benchmark
UNION ALL SELECT 'stability', model_name, mean_attention_stability, row_number() OVER (ORDER BY mean_attention_stability DESC, model_name) FROM e5_model_benchmark
UNION ALL SELECT 'reliability', model_name, mean_consensus_reliability, row_number() OVER (ORDER BY mean_consensus_reliability DESC, model_name) FROM e5_model_benchmark
UNION ALL SELECT 'risk', model_name, mean_risk, row_number() OVER (ORDER BY mean_risk, model_name) FROM e5_model_benchmark
UNION ALL SELECT 'uncertainty', model_name, mean_uncertainty, row_number() OVER (ORDER BY mean_uncertainty, model_name) FROM e5_model_benchmark
UNION ALL SELECT 'instability', model_name, mean_instability, row_number() OVER (ORDER BY mean_instability, model_name) FROM e5_model_benchmark
UNION ALL SELECT 'attention_drift', model_name, mean_attention_drift, row_number() OVER (ORDER BY mean_attention_drift, model_name) FROM e5_model_benchmark

-- name: e5_summary
SELECT count(*) AS total_models, (SELECT model_name FROM e5_model_benchmark ORDER BY benchmark_score DESC, mean_robustness DESC, model_name LIMIT 1) AS best_robustness_model, (SELECT model_name FROM e5_model_benchmark ORDER BY mean_instability, model_name LIMIT 1) AS most_stable_model, (SELECT model_name FROM e5_model_benchmark ORDER BY mean_risk, model_name LIMIT 1) AS lowest_risk_model,
  (SELECT model_name FROM e5_model_benchmark ORDER BY mean_attention_stability DESC, model_name LIMIT 1) AS best_attention_stability_model, (SELECT model_name FROM e5_model_benchmark ORDER BY mean_robustness DESC, model_name LIMIT 1) AS strongest_perturbation_resilience, (SELECT model_name FROM e5_model_benchmark ORDER BY mean_consensus_reliability DESC, model_name LIMIT 1) AS reliability_leader
FROM e5_model_benchmark

-- name: e6_perturbation_benchmark
WITH b AS (SELECT avg(robustness) AS robustness, avg(instability) AS instability, avg(uncertainty) AS uncertainty, avg(attention_drift) AS attention_drift, avg(consensus_reliability) AS consensus_reliability, avg(risk) AS risk, avg(disagreement_rate) AS disagreement_rate FROM records WHERE lower(perturbation_type) IN ('clean', 'original', 'baseline')),
d AS (SELECT perturbation_type, count(*) AS n, round(avg(robustness) - (SELECT robustness FROM b), 6) AS delta_robustness, round(avg(instability) - (SELECT instability FROM b), 6) AS delta_instability, round(avg(uncertainty) - (SELECT uncertainty FROM b), 6) AS delta_uncertainty, round(avg(attention_drift) - (SELECT attention_drift FROM b), 6) AS delta_attention_drift, round(avg(consensus_reliability) - (SELECT consensus_reliability FROM b), 6) AS delta_consensus_reliability, round(avg(risk) - (SELECT risk FROM b), 6) AS delta_risk, round(avg(disagreement_rate) - (SELECT disagreement_rate FROM b), 6) AS delta_disagreement_rate FROM records GROUP BY perturbation_type),
p AS (SELECT *, -delta_robustness AS degradation_impact, round((delta_disagreement_rate + delta_uncertainty + delta_attention_drift) / 3, 6) AS collapse_pressure FROM d)
SELECT *, row_number() OVER (ORDER BY collapse_pressure DESC, degradation_impact DESC, perturbation_type) AS place FROM p

-- name: e6_summary
SELECT count(*) AS total_perturbations, arg_min(perturbation_type, place) AS most_disruptive, (SELECT perturbation_type FROM e6_perturbation_benchmark ORDER BY delta_uncertainty DESC, perturbation_type LIMIT 1) AS most_uncertain,
  (SELECT perturbation_type FROM e6_perturbation_benchmark ORDER BY degradation_impact DESC, perturbation_type LIMIT 1) AS most_fragile, round(avg(degradation_impact), 6) AS mean_degradation_impact, round(avg(delta_disagreement_rate), 6) AS mean_disagreement_escalation,
  round(avg(delta_uncertainty), 6) AS mean_uncertainty_escalation, round(avg(delta_attention_drift), 6) AS mean_attention_drift_impact FROM e6_perturbation_benchmark

-- name: seed_scores
SELECT model_name, seed, avg(robustness) AS score
FROM records
GROUP BY model_name, seed

-- name: e7_seed_statistics
SELECT model_name, count(*) AS seeds, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(median(score),
  6) AS median
FROM seed_scores
GROUP BY model_name

-- name: student_quantiles
WITH RECURSIVE d AS (SELECT DISTINCT (SELECT count(*) FROM seed_scores x WHERE x.model_name = m.model_name) - 1 AS df FROM seed_scores m),
b AS (
  SELECT df, 0e0 AS lo, 1000e0 AS hi, 0 AS i FROM d WHERE df > 0
  UNION ALL
  SELECT df, CASE WHEN tail > 0.05e0 THEN mid ELSE lo END, CASE WHEN tail > 0.05e0 THEN hi ELSE mid END, i + 1 FROM (
    SELECT *, CASE WHEN df % 2 = 0
      THEN 1 - sin(th) * list_sum(list_transform(range(df // 2), lambda k: coalesce(list_aggregate(list_transform(range(1, k + 1), lambda j: (2e0 * j - 1) / (2e0 * j)), 'product'), 1e0) * pow(cos(th), 2 * k)))
      ELSE 1 - 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range((df - 1) // 2), lambda k: coalesce(list_aggregate(list_transform(range(1, k + 1), lambda j: 2e0 * j / (2e0 * j + 1)), 'product'), 1e0) * pow(cos(th), 2 * k + 1))), 0)) END AS tail
    FROM (SELECT df, lo, hi, i, (lo + hi) / 2 AS mid, atan((lo + hi) / 2 / sqrt(df::DOUBLE)) AS th FROM b WHERE i < 80) x) y)
SELECT df, (lo + hi) / 2 AS q FROM b WHERE i = 80

-- name: e7_intervals
WITH m AS (SELECT model_name, count(*) AS seeds, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS std FROM seed_scores GROUP BY model_name)
SELECT model_name, seeds, round(mean, 4) AS mean, round(mean - coalesce(q * std / sqrt(seeds::DOUBLE), 0), 4) AS ci_lower, round(mean + coalesce(q * std / sqrt(seeds::DOUBLE), 0), 4) AS ci_upper
FROM m LEFT JOIN student_quantiles ON df = seeds - 1

-- name: best_model
SELECT model_name
FROM (SELECT model_name, row_number() OVER (ORDER BY avg(score) DESC, model_name) AS place
FROM seed_scores
GROUP BY model_name) o
WHERE place = 1

-- name: best_scores
SELECT s.seed, s.score
FROM seed_scores s JOIN best_model b ON s.model_name = b.model_name

-- name: paired_tests
WITH d AS (SELECT s.model_name, s.score, b.score AS best, b.score - s.score AS d FROM seed_scores s JOIN best_scores b ON s.seed = b.seed WHERE s.model_name NOT IN (SELECT model_name FROM best_model)),
g AS (SELECT model_name, count(*) AS pairs, avg(d) AS m, stddev_samp(d) AS sd, avg(best) - avg(score) AS gap, sqrt((var_samp(best) + var_samp(score)) / 2e0) AS pooled FROM d GROUP BY model_name)
SELECT model_name, pairs, CASE WHEN pairs < 2 OR pooled = 0 THEN 0e0 ELSE gap / pooled END AS cohens_d,
  CASE WHEN pairs < 2 OR (sd = 0 AND m = 0) THEN 0e0 WHEN sd = 0 THEN sign(m) * 'inf'::DOUBLE ELSE m / (sd / sqrt(pairs::DOUBLE)) END AS t FROM g

-- name: e8_against_best
SELECT model_name, pairs, round(cohens_d, 4) AS cohens_d, round(t, 4) AS t FROM paired_tests

-- name: ranked_differences
WITH d AS (SELECT s.model_name, b.score - s.score AS d, round(abs(b.score - s.score), 12) AS a FROM seed_scores s JOIN best_scores b ON s.seed = b.seed WHERE s.model_name NOT IN (SELECT model_name FROM best_model))
SELECT x.model_name, x.d, x.a, count(*) FILTER (WHERE y.a < x.a) + (count(*) FILTER (WHERE y.a = x.a) + 1) / 2.0e0 AS rank FROM d x JOIN d y ON x.model_name = y.model_name AND y.a <= x.a WHERE x.a > 0 AND y.a > 0 GROUP BY ALL

-- name: e8_signed_ranks
SELECT model_name, count(*) AS n, least(coalesce(sum(rank) FILTER (WHERE d > 0), 0), coalesce(sum(rank) FILTER (WHERE d < 0), 0)) AS wilcoxon FROM ranked_differences GROUP BY model_name

-- name: student_tails
WITH a AS (SELECT model_name, pairs - 1 AS df, atan(abs(t) / sqrt(greatest(pairs - 1, 1)::DOUBLE)) AS th FROM paired_tests),
s AS (SELECT model_name, df, th,
  list_sum(list_transform(range(greatest(df // 2, 0)), lambda k: coalesce(list_aggregate(list_transform(range(1, k + 1), lambda j: (2e0 * j - 1) / (2e0 * j)), 'product'), 1e0) * pow(cos(th), 2 * k))) AS even,
  list_sum(list_transform(range(greatest((df - 1) // 2, 0)), lambda k: coalesce(list_aggregate(list_transform(range(1, k + 1), lambda j: 2e0 * j / (2e0 * j + 1)), 'product'), 1e0) * pow(cos(th), 2 * k + 1))) AS odd FROM a)
SELECT model_name, CASE WHEN df < 1 THEN 1e0 WHEN df % 2 = 0 THEN 1 - sin(th) * even ELSE 1 - 2 / pi() * (th + sin(th) * coalesce(odd, 0)) END AS p FROM s

-- name: rank_tails
WITH l AS (SELECT model_name, list(rank ORDER BY rank) AS ranks FROM ranked_differences GROUP BY model_name)
SELECT w.model_name, least(1e0, 2e0 * len(list_filter(range(1 << w.n), lambda x: coalesce(list_sum(list_transform(range(w.n), lambda i: CASE WHEN (x >> i) % 2 = 1 THEN l.ranks[i + 1] ELSE 0 END)), 0) <= w.wilcoxon)) / (1 << w.n)) AS p
FROM e8_signed_ranks w JOIN l USING (model_name)

-- name: e9_significance
SELECT t.model_name, round(t.cohens_d, 4) AS cohens_d,
  CASE WHEN pairs < 2 THEN 'Insufficient data' WHEN abs(t.cohens_d) < 0.2e0 THEN 'Negligible' WHEN abs(t.cohens_d) < 0.5e0 THEN 'Small' WHEN abs(t.cohens_d) < 0.8e0 THEN 'Medium' ELSE 'Large' END AS effect,
  round(t.t, 4) AS t, round(s.p, 6) AS p_t, CASE WHEN pairs >= 3 THEN coalesce(w.wilcoxon, 0e0) ELSE 0e0 END AS wilcoxon, CASE WHEN pairs >= 3 THEN round(coalesce(r.p, 1e0), 6) ELSE 1e0 END AS p_wilcoxon,
  CASE WHEN s.p < 0.001e0 THEN '***' WHEN s.p < 0.01e0 THEN '**' WHEN s.p < 0.05e0 THEN '*' ELSE 'ns' END AS stars
FROM paired_tests t JOIN student_tails s USING (model_name) LEFT JOIN e8_signed_ranks w USING (model_name) LEFT JOIN rank_tails r USING (model_name)

-- name: runs
SELECT user_id AS experiment, event_type AS stage, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'completed' END AS status FROM events

-- name: e10_stage_usage
SELECT stage, count(*) AS runs, count(DISTINCT experiment) AS experiments
FROM runs
GROUP BY stage

-- name: e10_registry
SELECT 'stage' AS kind, event_type AS name, count(DISTINCT (user_id, event_id % 37)) AS experiments FROM events GROUP BY event_type
UNION ALL SELECT 'model', concat('m', event_id % 4), count(DISTINCT (user_id, event_id % 37)) FROM events GROUP BY 2

-- name: e10_totals
SELECT count(DISTINCT (user_id, event_id % 37)) AS total_experiments, count(DISTINCT (user_id, event_id % 37)) AS experiment_ids FROM events

-- name: e10_execution
SELECT count(DISTINCT experiment) AS experiments, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, round(avg((status = 'completed')::INT), 6) AS integrity FROM runs

-- name: e11_class_counts
SELECT true_label, count(*) AS n, round(least(count(*) / 50e0, 1e0), 6) AS sufficiency, round(count(*) / CAST((SELECT count(*)
FROM log) AS DOUBLE), 6) AS share
FROM log
GROUP BY true_label

-- name: e11_readiness
WITH c AS (SELECT count(*) AS classes, sum(n) AS rows_, min(n) / max(n)::DOUBLE AS balance, round(avg(sufficiency), 6) AS mean_sufficiency, count(*) FILTER (WHERE n < 50) AS small_classes FROM e11_class_counts),
l AS (SELECT count(DISTINCT perturbation_type) FILTER (WHERE severity_level <> 'clean') AS profiles, count(DISTINCT severity_level) FILTER (WHERE severity_level IN ('mild', 'moderate', 'severe')) AS levels, count(DISTINCT model_name) AS models FROM log),
x AS (SELECT *, 1e0 AS validation_coverage, round(profiles / levels::DOUBLE, 6) AS perturbation_coverage, round(least(rows_ / 50e0, 1), 6) AS sample_sufficiency, round(least(models / classes::DOUBLE, 1), 6) AS calibration_sufficiency FROM c, l)
SELECT classes, round(balance, 6) AS balance, mean_sufficiency, small_classes, balance < 0.5 AS unbalanced, validation_coverage, perturbation_coverage, sample_sufficiency, calibration_sufficiency,
  round(100 * (balance + validation_coverage + perturbation_coverage + sample_sufficiency + calibration_sufficiency) / 5, 6) AS readiness_score,
  concat_ws('|', CASE WHEN balance < 0.5 THEN 'class_balance' END, CASE WHEN perturbation_coverage < 1 THEN 'perturbation_coverage' END, CASE WHEN sample_sufficiency < 0.6 THEN 'sample_sufficiency' END, CASE WHEN calibration_sufficiency < 0.5 THEN 'calibration_sufficiency' END) AS warnings FROM x

-- name: spread_of_models
SELECT model_name, avg(confidence) AS mean, stddev_pop(confidence) AS std, min(confidence) AS low, max(confidence) AS high, arg_min(confidence, seq) FILTER (WHERE severity_level IN ('clean', 'none', 'original')) AS original
FROM log GROUP BY model_name

-- name: c2_stability
WITH w AS (
  SELECT model_name, perturbation_type, abs(s.original - l.confidence) AS impact, row_number() OVER (PARTITION BY model_name ORDER BY abs(s.original - l.confidence) DESC, perturbation_type DESC) AS n
  FROM log l JOIN spread_of_models s USING (model_name) WHERE severity_level NOT IN ('clean', 'none', 'original')
)
SELECT s.model_name, coalesce(original, mean) AS original_confidence, round(mean, 6) AS mean_confidence, round(std, 6) AS std_confidence, low AS min_confidence, high AS max_confidence,
  round(coalesce(original - low, 0), 6) AS confidence_drop, round(mean - 0.25, 6) AS above_chance, w.perturbation_type AS most_damaging, round(w.impact, 6) AS greatest_impact, mean > 0.98 AND std < 0.01 AS saturated
FROM spread_of_models s LEFT JOIN w ON w.model_name = s.model_name AND w.n = 1

-- name: moved
SELECT j.model_name, j.sample_id, j.perturbation_type, j.severity_level, j.confidence, abs(coalesce(j.clean_confidence, o.original) - j.confidence) AS delta, j.predicted_class <> coalesce(j.clean_class, o.class) AS flipped
FROM j2_against_clean j JOIN (SELECT model_name, arg_min(confidence, seq) AS original, arg_min(predicted_class, seq) AS class FROM base GROUP BY model_name) o USING (model_name)

-- name: error_of_models
WITH b AS (
  SELECT model_name, confidence, (predicted_class = true_label)::INT AS hit, least(9, len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda x: x <= confidence))) AS bin, confidence BETWEEN 0 AND 1 AS inside
  FROM log WHERE true_label IS NOT NULL
), g AS (SELECT model_name, bin, inside, count(*) AS n, abs(avg(hit) - avg(confidence)) AS off FROM b GROUP BY ALL)
SELECT model_name, sum(n * off) FILTER (WHERE inside) / sum(n) AS ece FROM g GROUP BY model_name

-- name: scores_of_models
SELECT s.model_name, 100e0 * (SELECT avg((NOT prediction_changed)::INT) FROM j2_against_clean j WHERE j.model_name = s.model_name) AS consistency, greatest(0, 100e0 * (1 - 2.5e0 * s.std)) AS stability,
  100e0 * (1 - (SELECT avg(flipped::INT) FROM moved m WHERE m.model_name = s.model_name)) AS resistance, greatest(0, 100e0 * (1 - e.ece)) AS calibration
FROM spread_of_models s JOIN error_of_models e USING (model_name)

-- name: c4_robustness
WITH t AS (SELECT *, round(0.3e0 * consistency + 0.3e0 * stability + 0.2e0 * resistance + 0.2e0 * calibration, 6) AS robustness_score FROM scores_of_models)
SELECT model_name, round(consistency, 6) AS consistency, round(stability, 6) AS stability, round(resistance, 6) AS resistance, round(calibration, 6) AS calibration, robustness_score,
  ['Poor robustness', 'Fair robustness', 'Moderate robustness', 'Good robustness', 'Excellent robustness'][1 + (robustness_score >= 60)::INT + (robustness_score >= 70)::INT + (robustness_score >= 80)::INT + (robustness_score >= 90)::INT] AS interpretation
FROM t

-- name: e12_consistency
SELECT round(corr(s.confidence_drop, c.robustness_score), 6) AS correlation, corr(s.confidence_drop, c.robustness_score) > -0.1 AS warning FROM c2_stability s JOIN c4_robustness c USING (model_name)

-- name: plates
SELECT CASE WHEN c_custkey % 97 = 0 THEN concat('RARE', c_custkey % 5) ELSE c_mktsegment END AS class_name, CASE WHEN c_custkey % 97 = 0 THEN 'Plate' ELSE concat('Plate', c_nationkey) END AS plate_name, c_custkey AS image_id
FROM customer

-- name: class_plates
SELECT DISTINCT class_name, plate_name
FROM plates
WHERE lower(plate_name) NOT LIKE '%conkey%'

-- name: plate_order
SELECT class_name, plate_name, row_number() OVER (PARTITION BY class_name ORDER BY md5(concat('42:', class_name, '/',
  plate_name)), plate_name) AS place, count(*) OVER (PARTITION BY class_name) AS n
FROM class_plates

-- name: g1_splits
WITH s AS (SELECT *, greatest(1, round_even(0.70e0 * n, 0)) AS a, greatest(1, round_even(0.15e0 * n, 0)) AS b FROM plate_order),
e AS (SELECT *, greatest(0, a + b + greatest(1, n - a - b) - n) AS more FROM s),
f AS (SELECT *, CASE WHEN n < 3 THEN 1 ELSE a - (more - least(more, b - 1)) END AS train, CASE WHEN n < 3 THEN n - 1 ELSE b - least(more, b - 1) END AS val FROM e)
SELECT class_name, plate_name, CASE WHEN place <= train THEN 'train' WHEN place <= train + val THEN 'val' ELSE 'test' END AS split FROM f

-- name: g2_images
SELECT p.class_name, p.plate_name, s.split, count(*) AS images
FROM plates p JOIN g1_splits s ON p.class_name = s.class_name AND p.plate_name = s.plate_name
GROUP BY p.class_name, p.plate_name, s.split

-- name: g2_totals
SELECT split, sum(images)::BIGINT AS images, count(*) AS plates, round(100e0 * sum(images) / (SELECT sum(images) FROM g2_images), 6) AS percent FROM g2_images GROUP BY split

-- name: split_classes
SELECT split, class_name, CAST(sum(images) AS BIGINT) AS images
FROM g2_images
GROUP BY split, class_name

-- name: g3_skew
SELECT split, class_name, images, round(images / CAST(sum(images) OVER (PARTITION BY split) AS DOUBLE), 6) AS share,
  images / CAST(sum(images) OVER (PARTITION BY split) AS DOUBLE) > 0.8e0 AND split <> 'train' AS skewed
FROM split_classes

-- name: g4_leaks
SELECT class_name, count(*) AS plates, count(*) FILTER (WHERE splits > 1) AS leaking
FROM (SELECT class_name, plate_name, count(DISTINCT split) AS splits
FROM g1_splits
GROUP BY class_name, plate_name) x
GROUP BY class_name

-- name: g4_class_sets
SELECT class_name, CASE WHEN bool_or(split = 'train') THEN 'train' ELSE 'val' END AS only_in FROM g1_splits WHERE split <> 'test' GROUP BY class_name HAVING count(DISTINCT split) = 1

-- name: survival
SELECT sample_id, avg(CASE WHEN models_agree THEN 1e0 ELSE 0e0 END) AS survival
FROM b3_stability
GROUP BY sample_id

-- name: components
SELECT c.sample_id, CASE WHEN c.n_classes = 1 THEN 1e0 ELSE 0e0 END AS agreement,
  CASE WHEN g.sample_id IS NULL THEN 0.5e0 ELSE 0.6e0 * (1e0 - g.confidence_gap) + 0.4e0 * g.confidence_mean END AS consistency,
  coalesce(s.survival, 0.5e0) AS stability,
  CASE v.severity WHEN 'low' THEN 1e0 WHEN 'moderate' THEN 1e0 - 1e0 / 3 WHEN 'high' THEN 1e0 - 2e0 / 3 WHEN 'critical' THEN 0e0
  ELSE CASE WHEN c.n_classes = 1 THEN 1e0 ELSE 0.5e0 END END AS severity, coalesce(1e0 - i.instability_score, 0.5e0) AS steadiness
FROM complete c
LEFT JOIN a6_confidence_gaps g ON c.sample_id = g.sample_id
LEFT JOIN survival s ON c.sample_id = s.sample_id
LEFT JOIN a9_sample_severity v ON c.sample_id = v.sample_id
LEFT JOIN b5_sample_instability i ON c.sample_id = i.sample_id

-- name: d1_reliability
SELECT sample_id, agreement AS agreement_strength, round(consistency, 6) AS confidence_consistency, round(stability,
  6) AS perturbation_stability, round(severity, 6) AS severity_reliability, round(steadiness, 6) AS instability_reliability,
  round(least(1e0, greatest(0e0, 0.25e0 * agreement + 0.2e0 * consistency + 0.25e0 * stability + 0.15e0 * severity + 0.15e0 *
  steadiness)), 6) AS reliability
FROM components

-- name: d2_reliability_summary
WITH s AS (
  SELECT count(*) AS samples, round(avg(reliability), 6) AS mean_reliability, min(reliability) AS min_reliability, max(reliability) AS max_reliability, round(median(reliability), 6) AS median_reliability,
    count(*) FILTER (WHERE reliability >= 0.7e0) AS reliable, count(*) FILTER (WHERE reliability < 0.3e0) AS unreliable, round(avg(agreement_strength), 6) AS mean_agreement, round(avg(confidence_consistency), 6) AS mean_consistency,
    round(avg(perturbation_stability), 6) AS mean_stability, round(avg(severity_reliability), 6) AS mean_severity, round(avg(instability_reliability), 6) AS mean_steadiness
  FROM d1_reliability)
SELECT *, (SELECT c FROM (VALUES ('agreement_strength', mean_agreement), ('confidence_consistency', mean_consistency), ('perturbation_stability', mean_stability), ('severity_reliability', mean_severity), ('instability_reliability', mean_steadiness)) v(c, x) ORDER BY x, c LIMIT 1) AS weakest
FROM s

-- name: ladder_sizes
SELECT sample_id, count(*) AS total_steps, count(*) FILTER (WHERE first_break IS NULL) AS steps_before,
  min(first_break) AS first_break
FROM breaks
GROUP BY sample_id

-- name: d3_breakdown
WITH t AS (SELECT l.sample_id, min(o.perturbation_type) AS trigger FROM ladder_sizes l JOIN observations o ON o.sample_id = l.sample_id AND o.severity_level = substr(l.first_break, 4) AND o.n_classes > 1 GROUP BY l.sample_id)
SELECT l.sample_id, CASE WHEN substr(l.first_break, 4) IN ('clean', 'none', 'original') THEN 'clean' ELSE coalesce(t.trigger, 'unknown') END AS collapse_trigger, substr(l.first_break, 4) AS collapse_severity, l.steps_before AS consensus_duration, l.total_steps, round(1e0 / (l.steps_before + 1), 6) AS escalation_speed, coalesce(i.instability_score, 0) AS instability_score
FROM ladder_sizes l LEFT JOIN t ON t.sample_id = l.sample_id LEFT JOIN b5_sample_instability i ON l.sample_id = i.sample_id WHERE l.first_break IS NOT NULL

-- name: d4_agreement
SELECT avg(CASE WHEN n_classes = 1 THEN 1e0 ELSE 0e0 END) AS persistence
FROM complete

-- name: d4_gap
SELECT 1e0 - avg(confidence_gap) AS stability
FROM a6_confidence_gaps

-- name: d4_survival
SELECT avg(CASE WHEN models_agree THEN 1e0 ELSE 0e0 END) AS survival
FROM b3_stability

-- name: d4_models
SELECT 1e0 - coalesce(stddev_samp(instability_score), 0e0) AS evenness
FROM b4_model_instability

-- name: d4_consistency
SELECT round(persistence, 6) AS agreement_persistence, round(stability, 6) AS confidence_stability, round(survival,
  6) AS consensus_survival, round(evenness, 6) AS cross_model_consistency,
  round((persistence + stability + survival + evenness) / 4, 6) AS overall
FROM d4_agreement
CROSS JOIN d4_gap
CROSS JOIN d4_survival
CROSS JOIN d4_models

-- name: d5_model_trust
SELECT model_name, round(1e0 - instability_score, 6) AS trust_contribution, rank() OVER (ORDER BY instability_score, model_name) AS trust_rank,
  CASE WHEN 1e0 - instability_score >= 0.7e0 THEN 'stabiliser' WHEN 1e0 - instability_score < 0.3e0 THEN 'destabiliser' ELSE 'neutral' END AS trust_label FROM b4_model_instability

-- name: d5_trust_summary
SELECT count(*) AS models, round(avg(trust_contribution), 6) AS mean_trust, round(max(trust_contribution) - min(trust_contribution), 6) AS trust_spread, first(model_name ORDER BY trust_rank) AS most_trusted, last(model_name ORDER BY trust_rank) AS least_trusted,
  count(*) FILTER (WHERE trust_label = 'stabiliser') AS stabilisers, count(*) FILTER (WHERE trust_label = 'neutral') AS neutrals, count(*) FILTER (WHERE trust_label = 'destabiliser') AS destabilisers FROM d5_model_trust

-- name: d6_fragile
SELECT l.sample_id, substr(l.first_break, 4) AS collapse_severity, CAST(substr(l.first_break, 1, 3) AS INT) AS collapse_rank
FROM ladder_sizes l
WHERE l.first_break IS NOT NULL AND CAST(substr(l.first_break, 1, 3) AS INT) BETWEEN 1 AND 1 AND l.sample_id IN (SELECT sample_id
FROM agreed)

-- name: d7_flags
SELECT a.sample_id, CASE WHEN g.confidence_gap > 0.3e0 THEN 'high_confidence_gap' END AS f1,
  CASE WHEN g.confidence_mean < 0.5e0 THEN 'low_mean_confidence' END AS f2,
  CASE WHEN f.sample_id IS NOT NULL THEN 'fragile_under_perturbation' END AS f3,
  CASE WHEN i.instability_score > 0.5e0 THEN 'high_instability' END AS f4
FROM agreed a
LEFT JOIN a6_confidence_gaps g ON a.sample_id = g.sample_id
LEFT JOIN d6_fragile f ON a.sample_id = f.sample_id
LEFT JOIN b5_sample_instability i ON a.sample_id = i.sample_id

-- name: d7_counted
SELECT sample_id, concat_ws('|', f1, f2, f3, f4) AS flags,
  (CASE WHEN f1 IS NULL THEN 0 ELSE 1 END + CASE WHEN f2 IS NULL THEN 0 ELSE 1 END + CASE WHEN f3 IS NULL THEN 0 ELSE 1 END +
  CASE WHEN f4 IS NULL THEN 0 ELSE 1 END) AS flag_count
FROM d7_flags

-- name: d7_false_consensus
SELECT sample_id, flags, flag_count, CASE WHEN flag_count >= 3 THEN 'severe' WHEN flag_count = 2 THEN 'moderate' ELSE 'mild' END
  AS false_consensus_severity
FROM d7_counted
WHERE flag_count > 0

-- name: d8_changes
SELECT sample_id, count(agreed_before) AS transitions,
  count(*) FILTER (WHERE agreed_before IS NOT NULL AND agreed_before <> models_agree) AS changes
FROM breaks
GROUP BY sample_id

-- name: d8_unstable
SELECT sample_id, transitions, changes, round(changes / CAST(transitions AS DOUBLE), 6) AS oscillation_rate
FROM d8_changes
WHERE transitions > 0 AND changes / CAST(nullif(transitions, 0) AS DOUBLE) > 0.3e0

-- name: d9_ids
SELECT sample_id
FROM d7_false_consensus UNION SELECT sample_id
FROM d6_fragile UNION SELECT sample_id
FROM d8_unstable

-- name: d9_summary
SELECT (SELECT count(*)
FROM d7_false_consensus) AS false_consensus, (SELECT count(*)
FROM d6_fragile) AS fragile, (SELECT count(*)
FROM d8_unstable) AS unstable, count(*) AS affected_samples
FROM d9_ids

-- name: d9_affected_samples
SELECT sample_id FROM d9_ids

-- name: d9_flag_counts
SELECT 'flag' AS part, name, count(*) AS samples FROM (SELECT unnest(string_split(flags, '|')) AS name FROM d7_false_consensus) x GROUP BY name
UNION ALL SELECT 'severity', false_consensus_severity, count(*) FROM d7_false_consensus GROUP BY false_consensus_severity

-- name: trust_steps
SELECT r.sample_id, r.reliability, f.false_consensus_severity,
  CASE WHEN r.reliability >= 0.85e0 THEN 'very_high' WHEN r.reliability >= 0.7e0 THEN 'high' WHEN r.reliability >= 0.45e0 THEN
  'moderate' WHEN r.reliability >= 0.25e0 THEN 'low' ELSE 'critical' END AS initial_label,
  CASE WHEN r.reliability >= 0.85e0 THEN 4 WHEN r.reliability >= 0.7e0 THEN 3 WHEN r.reliability >= 0.45e0 THEN 2 WHEN
  r.reliability >= 0.25e0 THEN 1 ELSE 0 END AS level,
  CASE f.false_consensus_severity WHEN 'severe' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END AS down
FROM d1_reliability r
LEFT JOIN d7_false_consensus f ON r.sample_id = f.sample_id

-- name: d10_trust
SELECT sample_id, reliability, initial_label, ['critical', 'low', 'moderate', 'high', 'very_high'][greatest(level - down, 0) + 1] AS trust_level, down > 0 AND level > 0 AS downgraded,
  CASE WHEN down > 0 AND level > 0 THEN 'false_consensus_' || false_consensus_severity END AS downgrade_reason FROM trust_steps

-- name: trust_levels
SELECT 'very_high' AS trust_level
UNION ALL SELECT 'high'
UNION ALL SELECT 'moderate'
UNION ALL SELECT 'low'
UNION ALL SELECT 'critical'

-- name: d11_trust_summary
SELECT v.trust_level, count(t.sample_id) AS samples, round(count(t.sample_id) / nullif((SELECT count(*) FROM d10_trust), 0)::DOUBLE, 6) AS rate, count(t.sample_id) FILTER (WHERE t.downgraded) AS downgraded, round(avg(t.reliability), 6) AS mean_reliability
FROM trust_levels v LEFT JOIN d10_trust t ON v.trust_level = t.trust_level GROUP BY v.trust_level

-- name: d11_trust_ids
SELECT trust_level, sample_id FROM d10_trust WHERE trust_level = 'critical' OR trust_level = 'very_high'

-- name: logits
SELECT vec_id AS sample_id, concat('m', m.model) AS model_name, label % 4 AS label,
  8e0 * embedding[16 * m.model + 1] + CASE WHEN label % 4 = 0 THEN 1.5e0 ELSE 0e0 END AS z0,
  8e0 * embedding[16 * m.model + 2] + CASE WHEN label % 4 = 1 THEN 1.5e0 ELSE 0e0 END AS z1,
  8e0 * embedding[16 * m.model + 3] + CASE WHEN label % 4 = 2 THEN 1.5e0 ELSE 0e0 END AS z2,
  8e0 * embedding[16 * m.model + 4] + CASE WHEN label % 4 = 3 THEN 1.5e0 ELSE 0e0 END AS z3
FROM embeddings
CROSS JOIN (SELECT 0 AS model
UNION ALL SELECT 1
UNION ALL SELECT 2
UNION ALL SELECT 3) m

-- name: exact
WITH x AS (SELECT *, list_max([z0, z1, z2, z3]) AS top FROM logits),
e AS (SELECT *, exp(z0 - top) AS e0, exp(z1 - top) AS e1, exp(z2 - top) AS e2, exp(z3 - top) AS e3 FROM x),
p AS (SELECT *, e0 + e1 + e2 + e3 AS s FROM e)
SELECT sample_id, model_name, label, [z0, z1, z2, z3] AS z, e0 / s AS p0, e1 / s AS p1, e2 / s AS p2, e3 / s AS p3,
  list_position([z0, z1, z2, z3], top)::INT - 1 AS predicted, 1 / s AS confidence FROM p

-- name: p2_probabilities
SELECT sample_id, model_name, label::INT AS label, 0 AS k, round(p0, 6) AS probability FROM exact UNION ALL SELECT sample_id, model_name, label::INT, 1, round(p1, 6) FROM exact
UNION ALL SELECT sample_id, model_name, label::INT, 2, round(p2, 6) FROM exact UNION ALL SELECT sample_id, model_name, label::INT, 3, round(p3, 6) FROM exact

-- name: coarse
WITH g AS (SELECT i, 0.05e0 * pow(pow(200e0, 1e0 / 63), i) AS t FROM range(64) r(i)),
n AS (SELECT model_name, t, avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t)))) - (z[label + 1] - list_max(z)) / t) AS loss FROM exact, g GROUP BY model_name, t)
SELECT model_name, arg_min(t, loss) AS t FROM n GROUP BY model_name

-- name: best_temperature
WITH g AS (SELECT model_name, greatest(t / pow(200e0, 1e0 / 63), 0.05e0) AS low, least(t * pow(200e0, 1e0 / 63), 10e0) AS high FROM coarse),
s AS (SELECT model_name, low + (high - low) * i / 63e0 AS t FROM g, range(64) r(i)),
n AS (SELECT model_name, t, avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t)))) - (z[label + 1] - list_max(z)) / t) AS loss FROM exact JOIN s USING (model_name) GROUP BY model_name, t)
SELECT model_name, arg_min(t, loss) AS temperature, min(loss) AS loss FROM n GROUP BY model_name

-- name: cooled
WITH x AS (SELECT *, list_transform(z, lambda v: exp((v - list_max(z)) / temperature)) AS e FROM exact JOIN best_temperature USING (model_name))
SELECT sample_id, model_name, label, predicted, list_transform(e, lambda v: v / list_sum(e)) AS p, 1 / list_sum(e) AS confidence, [p0, p1, p2, p3][predicted + 1] AS raw FROM x

-- name: p4_predictions
SELECT sample_id, model_name, label::INT AS label, predicted, round(confidence, 6) AS confidence, round(raw, 6) AS raw_confidence, 'class' || predicted AS class_name FROM cooled

-- name: p3_rescaled
SELECT sample_id, model_name, k::INT AS k, round(p[k + 1], 6) AS probability FROM cooled, range(4) r(k)

-- name: c12_temperature
SELECT model_name, round(temperature, 4) AS temperature, round(loss, 6) AS loss FROM best_temperature

-- name: class_scales
WITH RECURSIVE d AS (
  SELECT model_name, i, 1 / temperature AS b0, 1 / temperature AS b1, 1 / temperature AS b2, 1 / temperature AS b3 FROM best_temperature, (SELECT 0 AS i)
  UNION ALL
  SELECT model_name, any_value(i) + 1,
    least(20e0, greatest(0.1e0, any_value(b0) - avg(z[1] * (p0 - (label = 0)::INT)) / avg(abs(z[1]) * p0 * (m - 2 * abs(z[1]) * p0 + abs(z[1]))))),
    least(20e0, greatest(0.1e0, any_value(b1) - avg(z[2] * (p1 - (label = 1)::INT)) / avg(abs(z[2]) * p1 * (m - 2 * abs(z[2]) * p1 + abs(z[2]))))),
    least(20e0, greatest(0.1e0, any_value(b2) - avg(z[3] * (p2 - (label = 2)::INT)) / avg(abs(z[3]) * p2 * (m - 2 * abs(z[3]) * p2 + abs(z[3]))))),
    least(20e0, greatest(0.1e0, any_value(b3) - avg(z[4] * (p3 - (label = 3)::INT)) / avg(abs(z[4]) * p3 * (m - 2 * abs(z[4]) * p3 + abs(z[4])))))
  FROM (
    SELECT *, abs(z[1]) * p0 + abs(z[2]) * p1 + abs(z[3]) * p2 + abs(z[4]) * p3 AS m FROM (
      SELECT model_name, i, b0, b1, b2, b3, label, z, e0 / s AS p0, e1 / s AS p1, e2 / s AS p2, e3 / s AS p3 FROM (
        SELECT *, e0 + e1 + e2 + e3 AS s FROM (
          SELECT d.*, e.label, e.z, exp(b0 * z[1]) AS e0, exp(b1 * z[2]) AS e1, exp(b2 * z[3]) AS e2, exp(b3 * z[4]) AS e3 FROM d JOIN exact e USING (model_name) WHERE d.i < 400) a) c) f) g
  GROUP BY model_name)
SELECT * FROM d WHERE i = 400

-- name: class_losses
SELECT s.model_name, [1 / b0, 1 / b1, 1 / b2, 1 / b3] AS t, avg(ln(exp(b0 * z[1]) + exp(b1 * z[2]) + exp(b2 * z[3]) + exp(b3 * z[4])) - [b0, b1, b2, b3][label + 1] * z[label + 1]) AS loss
FROM class_scales s JOIN exact e USING (model_name) GROUP BY ALL

-- name: c12_class_temperatures
SELECT model_name, k::INT AS k, round(t[k + 1], 3) AS temperature, round(loss, 6) AS loss FROM class_losses, range(4) r(k)

-- name: p2_by_class
WITH x AS (SELECT e.sample_id, e.model_name, e.label, list_transform([1, 2, 3, 4], lambda i: e.z[i] / l.t[i]) AS z FROM exact e JOIN class_losses l USING (model_name))
SELECT sample_id, model_name, label::INT AS label, list_position(z, list_max(z))::INT - 1 AS predicted, round(1 / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))), 4) AS confidence FROM x

-- name: bins15
SELECT model_name, len(list_filter(range(15), lambda i: i / 15e0 < confidence)) - 1 AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg((predicted = label)::INT) AS accuracy FROM exact GROUP BY ALL

-- name: c7_bins
SELECT model_name, bin::INT AS bin, n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM bins15 WHERE bin >= 0

-- name: c7_ece
WITH e AS (SELECT model_name, sum(n * abs(accuracy - mean_confidence)) / sum(n) AS e, max(abs(accuracy - mean_confidence)) AS m FROM bins15 GROUP BY model_name)
SELECT model_name, round(e, 6) AS ece, round(m, 6) AS mce, CASE WHEN e < 0.02 THEN 'Well-calibrated' WHEN e < 0.05 THEN 'Acceptable calibration' WHEN e < 0.1 THEN 'Moderate overconfidence — consider temperature scaling' ELSE 'Severe overconfidence — model predictions are unreliable' END AS interpretation FROM e

-- name: c8_overconfidence
SELECT model_name, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(confidence) FILTER (WHERE predicted = label), 6) AS mean_correct, round(avg(confidence) FILTER (WHERE predicted <> label), 6) AS mean_wrong,
  round(avg((confidence >= 0.9e0)::INT), 6) AS share_confident, round(avg((confidence >= 0.9e0 AND predicted <> label)::INT), 6) AS share_confident_wrong,
  count(*) FILTER (WHERE confidence >= 0.9e0) AS confident, count(*) FILTER (WHERE confidence >= 0.9e0 AND predicted <> label) AS confident_wrong
FROM exact GROUP BY model_name

-- name: c9_curve
SELECT model_name, least(9, len(list_filter(range(1, 10), lambda i: i / 10e0 <= confidence)))::INT AS bin, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg((predicted = label)::INT), 6) AS accuracy FROM exact GROUP BY ALL HAVING count(*) >= 5

-- name: c9_reliability_rows
WITH b AS (SELECT model_name, len(list_filter(range(10), lambda i: i / 10e0 < confidence)) - 1 AS bin, count(*) AS n, avg(confidence) AS c, avg((predicted = label)::INT) AS a FROM exact GROUP BY ALL)
SELECT m.model_name, r.bin::INT AS bin, coalesce(n, 0) AS n, round(coalesce(c, 0), 6) AS mean_confidence, round(coalesce(a, 0), 6) AS accuracy, round(coalesce(c - a, 0), 6) AS gap
FROM (SELECT DISTINCT model_name FROM exact) m CROSS JOIN range(10) r(bin) LEFT JOIN b ON b.model_name = m.model_name AND b.bin = r.bin

-- name: c10_calibration_summary
WITH b AS (SELECT model_name, len(list_filter(range(15), lambda i: i / 15e0 < confidence)) AS bin, count(*) AS n, abs(avg(confidence) - avg((predicted = label)::INT)) AS off FROM cooled GROUP BY ALL),
t AS (SELECT model_name, sum(n * off) / sum(n) AS after FROM b GROUP BY model_name),
e AS (SELECT model_name, sum(n * abs(accuracy - mean_confidence)) / sum(n) AS ece, sum(n * accuracy) / sum(n) AS a, sum(n * mean_confidence) / sum(n) AS c FROM bins15 GROUP BY model_name)
SELECT model_name, round(a, 6) AS accuracy, round(c, 6) AS mean_confidence, round(ece, 6) AS ece, round(after, 6) AS ece_after, round(ece - after, 6) AS improvement,
  concat_ws('|', CASE WHEN c - a > 0.1e0 THEN 'overconfident' END, CASE WHEN ece > 0.05e0 THEN 'miscalibrated' END, CASE WHEN c > 0.97e0 AND a < 0.95e0 THEN 'saturated' END) AS flags
FROM e JOIN t USING (model_name)

-- name: exact_bins
WITH x AS (SELECT model_name, coalesce(confidence, 0) AS c, (predicted_class = true_label)::INT AS hit FROM log)
SELECT model_name, len(list_filter(range(10), lambda i: i / 10e0 < c)) AS bin, count(*) AS n, avg(c) AS bin_confidence, avg(hit) AS bin_accuracy FROM x WHERE c > 0 AND c <= 1 GROUP BY ALL

-- name: p12_correctness
SELECT model_name, 'true_label' AS rule, count(*) AS n, count(*) FILTER (WHERE predicted_class = true_label) AS correct FROM log GROUP BY model_name
UNION ALL SELECT model_name, 'prediction_changed', count(*), count(*) FILTER (WHERE NOT prediction_changed) FROM j2_against_clean GROUP BY model_name
UNION ALL SELECT model_name, 'original', count(*), count(*) FILTER (WHERE predicted_class = own) FROM log JOIN (SELECT model_name, arg_max(predicted_class, seq) AS own FROM base GROUP BY model_name) o USING (model_name) GROUP BY model_name

-- name: c11_bins
SELECT model_name, bin::INT AS bin, round(bin_confidence, 6) AS bin_confidence, round(bin_accuracy, 6) AS bin_accuracy, n AS bin_count FROM exact_bins

-- name: c11_proxy
WITH o AS (SELECT model_name, arg_min(predicted_class, seq) AS own FROM base GROUP BY model_name),
x AS (SELECT l.model_name, coalesce(confidence, 0) AS c, (predicted_class = own)::INT AS hit FROM log l JOIN o USING (model_name)),
b AS (SELECT model_name, count(*) AS n, abs(avg(c) - avg(hit)) AS off FROM x WHERE c > 0 AND c <= 1 GROUP BY model_name, len(list_filter(range(10), lambda i: i / 10e0 < c)))
SELECT model_name, count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(c), 6) AS mean_confidence, round(stddev_pop(c), 6) AS std_confidence, round((SELECT sum(n * off) FROM b WHERE b.model_name = x.model_name) / count(*), 6) AS ece, 'proxy' AS calibration_mode
FROM x GROUP BY model_name

-- name: c11_frame
WITH x AS (SELECT model_name, coalesce(confidence, 0) AS c, (predicted_class = true_label)::INT AS hit FROM log)
SELECT model_name, count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(c), 6) AS mean_confidence, round(stddev_pop(c), 6) AS std_confidence, round((SELECT sum(n * abs(bin_confidence - bin_accuracy)) FROM exact_bins b WHERE b.model_name = x.model_name) / count(*), 6) AS ece, 'true_label' AS calibration_mode
FROM x GROUP BY model_name

-- name: c11_summary
SELECT count(*) AS models, round(avg(ece), 6) AS mean_ece, max(ece) AS max_ece, round(avg(accuracy), 6) AS mean_consistency, count(*) FILTER (WHERE calibration_mode = 'true_label') AS by_true_label, count(*) FILTER (WHERE calibration_mode = 'proxy') AS by_proxy,
  arg_min(model_name, ece) AS best_calibrated, arg_max(model_name, ece) AS worst_calibrated, round(avg(mean_confidence), 6) AS mean_confidence FROM c11_frame

-- name: names
SELECT DISTINCT model_name FROM exact

-- name: class_numbers
SELECT 0 AS k
UNION ALL SELECT 1
UNION ALL SELECT 2
UNION ALL SELECT 3

-- name: cells
SELECT model_name, label, predicted, count(*) AS n FROM exact GROUP BY model_name, label, predicted

-- name: c13_confusion
SELECT m.model_name, t.k AS true_class, p.k AS predicted_class, coalesce(c.n, 0) AS n, round(coalesce(coalesce(c.n,
  0) / CAST(nullif(sum(coalesce(c.n, 0)) OVER (PARTITION BY m.model_name, t.k), 0) AS DOUBLE), 0e0), 6) AS row_share
FROM names m
CROSS JOIN class_numbers t
CROSS JOIN class_numbers p
LEFT JOIN cells c ON c.model_name = m.model_name AND c.label = t.k AND c.predicted = p.k

-- name: c13_errors
SELECT * FROM c13_confusion WHERE true_class <> predicted_class AND n > 0

-- name: class_sums
SELECT model_name, k, CAST(sum(CASE WHEN label = k AND predicted = k THEN n ELSE 0 END) AS DOUBLE) AS hits,
  CAST(sum(CASE WHEN predicted = k THEN n ELSE 0 END) AS DOUBLE) AS called,
  CAST(sum(CASE WHEN label = k THEN n ELSE 0 END) AS DOUBLE) AS support
FROM cells
CROSS JOIN class_numbers
GROUP BY model_name, k

-- name: class_scores
SELECT model_name, k, support, hits, coalesce(hits / nullif(called, 0e0), 0e0) AS class_precision,
  coalesce(hits / nullif(support, 0e0), 0e0) AS recall, coalesce(2e0 * hits / nullif(called + support, 0e0), 0e0) AS f1
FROM class_sums

-- name: c14_report
SELECT model_name, concat('class', k) AS row_name, round(class_precision, 6) AS class_precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support
FROM class_scores
UNION ALL SELECT model_name, 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), sum(support)
FROM class_scores
GROUP BY model_name
UNION ALL SELECT model_name, 'macro', round(avg(class_precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)
FROM class_scores
GROUP BY model_name
UNION ALL SELECT model_name, 'weighted', round(sum(class_precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)
FROM class_scores
GROUP BY model_name

-- name: long_scores
SELECT model_name, label, k, [p0, p1, p2, p3][k + 1] AS score FROM exact, range(4) r(k)

-- name: score_counts
SELECT model_name, k::INT AS k, score, count(*) FILTER (WHERE label = k) AS pos, count(*) FILTER (WHERE label <> k) AS neg FROM long_scores GROUP BY model_name, k, score

-- name: cumulated
SELECT *, sum(pos) OVER (PARTITION BY model_name, k ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY model_name,
  k ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY model_name, k) AS all_pos, sum(neg) OVER (PARTITION BY model_name,
  k) AS all_neg
FROM score_counts

-- name: c15_roc_points
SELECT model_name, k, round(score, 6) AS score, round(fp / CAST(nullif(all_neg, 0) AS DOUBLE), 6) AS fpr, round(tp / CAST(nullif(all_pos,
  0) AS DOUBLE), 6) AS tpr
FROM cumulated

-- name: c15_auc
SELECT model_name, k, round(sum(neg * (tp - pos / 2e0)) / CAST(nullif(max(all_pos) * max(all_neg), 0) AS DOUBLE), 6) AS auc
FROM cumulated
GROUP BY model_name, k

-- name: c16_pr_points
SELECT model_name, k, round(score, 6) AS score, round(tp / (tp + fp), 6) AS class_precision, round(tp / nullif(all_pos, 0)::DOUBLE, 6) AS recall FROM cumulated

-- name: c16_average_precision
SELECT model_name, k, round(sum(pos / CAST(nullif(all_pos, 0) AS DOUBLE) * (tp / CAST(tp + fp AS DOUBLE))),
  6) AS average_precision
FROM cumulated
GROUP BY model_name, k

-- name: c17_by_class
SELECT label::INT AS label, round(min(confidence), 6) AS min_confidence, round(median(confidence), 6) AS median_confidence, round(max(confidence), 6) AS max_confidence, count(*) AS n FROM exact GROUP BY label

-- name: c17_density
WITH l AS (SELECT label, min(confidence) AS low, (max(confidence) - min(confidence)) / 20 AS wide, count(*) AS total FROM exact GROUP BY label)
SELECT label::INT AS label, least(19, floor((confidence - low) / wide))::INT AS bin, count(*) AS n, round(count(*) / (max(total) * max(wide)), 6) AS density FROM exact JOIN l USING (label) WHERE wide > 0 GROUP BY 1, 2

-- name: c17_histogram
SELECT model_name, least(19, len(list_filter(range(1, 20), lambda i: i / 20e0 <= confidence)))::INT AS bin, count(*) AS n FROM exact GROUP BY ALL

-- name: c19_inference_summary
SELECT model_name, predicted, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(raw), 6) AS mean_raw_confidence FROM cooled GROUP BY model_name, predicted

-- name: r1_disagreement
SELECT sample_id, 0.6e0 * max(disagreement_score) + 0.4e0 * avg(disagreement_score) AS disagreement
FROM p9_scored_pairs
GROUP BY sample_id

-- name: r2_confidence
SELECT sample_id, 0.65e0 * confidence_gap + 0.35e0 * (1e0 - confidence_mean) AS confidence
FROM a6_confidence_gaps

-- name: r3_consensus
SELECT sample_id, 1e0 - avg(reliability) AS consensus
FROM d1_reliability
GROUP BY sample_id

-- name: r3_from_labels
SELECT sample_id, avg(CASE trust_level WHEN 'very_high' THEN 0.1e0 WHEN 'high' THEN 0.25e0 WHEN 'moderate' THEN 0.5e0 WHEN 'low' THEN 0.75e0 WHEN 'critical' THEN 0.95e0 ELSE 0.5e0 END) AS consensus FROM d10_trust GROUP BY sample_id

-- name: turmoil
WITH o AS (SELECT sample_id, list(models_agree ORDER BY severity_rank, severity_level) AS states, list(severity_rank ORDER BY severity_rank, severity_level) AS ranks FROM b3_stability GROUP BY sample_id)
SELECT sample_id, least(1, greatest(0, 0.6e0 * len(list_filter(range(1, len(states)), lambda i: states[i] <> states[i + 1])) / greatest(len(states) - 1, 1)
  + 0.4e0 * coalesce(least(1, greatest(0, 1 - (ranks[nullif(list_position(states, false), 0)] - 1) / greatest(list_max(ranks), 1)::DOUBLE)), 0))) AS turmoil FROM o

-- name: r4_signals
SELECT sample_id, 1e0 - least(collapse_rank, 5) / 5e0 AS fragility FROM d6_fragile
UNION ALL SELECT sample_id, least(1e0, CASE false_consensus_severity WHEN 'mild' THEN 0.5e0 WHEN 'moderate' THEN 0.7e0 ELSE 0.9e0 END + least(0.15e0, 0.05e0 * (flag_count - 1))) FROM d7_false_consensus
UNION ALL SELECT sample_id, escalation_speed FROM d3_breakdown UNION ALL SELECT sample_id, turmoil FROM turmoil

-- name: r4_fragility
SELECT sample_id, max(fragility) AS fragility
FROM r4_signals
GROUP BY sample_id

-- name: r5_escalation
SELECT sample_id, (escalation_speed + 1e0 / greatest(consensus_duration, 1)) / 2e0 AS escalation FROM d3_breakdown
UNION ALL SELECT sample_id, turmoil FROM turmoil WHERE NOT EXISTS (SELECT 1 FROM d3_breakdown)

-- name: risk_ids
SELECT sample_id
FROM r1_disagreement UNION SELECT sample_id
FROM r2_confidence UNION SELECT sample_id
FROM r3_consensus UNION SELECT sample_id
FROM b5_sample_instability UNION SELECT sample_id
FROM r4_fragility UNION SELECT sample_id
FROM r5_escalation

-- name: risk_parts
SELECT u.sample_id, a.disagreement, b.confidence, c.consensus, i.instability_score AS instability, f.fragility, e.escalation
FROM risk_ids u
LEFT JOIN r1_disagreement a ON u.sample_id = a.sample_id
LEFT JOIN r2_confidence b ON u.sample_id = b.sample_id
LEFT JOIN r3_consensus c ON u.sample_id = c.sample_id
LEFT JOIN b5_sample_instability i ON u.sample_id = i.sample_id
LEFT JOIN r4_fragility f ON u.sample_id = f.sample_id
LEFT JOIN r5_escalation e ON u.sample_id = e.sample_id

-- name: r6_sample_risk
WITH long AS (
  UNPIVOT (SELECT sample_id, disagreement, confidence, consensus, instability, fragility, escalation FROM risk_parts) ON disagreement, confidence, consensus, instability, fragility, escalation INTO NAME factor VALUE v
), w AS (
  SELECT *, least(1, greatest(0, v)) AS x, MAP {'disagreement': 0.22e0, 'confidence': 0.20e0, 'consensus': 0.20e0, 'instability': 0.16e0, 'fragility': 0.12e0, 'escalation': 0.10e0}[factor] AS weight,
    list_position(['disagreement', 'confidence', 'consensus', 'instability', 'fragility', 'escalation'], factor) AS nth
  FROM long
), s AS (
  SELECT sample_id, round(sum(weight * x) / sum(weight), 6) AS risk_score, list(factor ORDER BY x DESC, nth) AS factors FROM w GROUP BY sample_id
)
SELECT p.sample_id, round(p.disagreement + 1e-9, 6) AS disagreement, round(p.confidence + 1e-9, 6) AS confidence, round(p.consensus + 1e-9, 6) AS consensus, p.instability, round(p.fragility + 1e-9, 6) AS fragility, round(p.escalation + 1e-9, 6) AS escalation,
  risk_score, factors[1] AS dominant_factor, array_to_string(factors[2:3], '|') AS secondary_factors, len(factors)::INT AS components,
  CASE WHEN risk_score >= 0.8 THEN 'critical' WHEN risk_score >= 0.6 THEN 'high' WHEN risk_score >= 0.35 THEN 'moderate' WHEN risk_score >= 0.15 THEN 'low' ELSE 'minimal' END AS risk_level
FROM risk_parts p JOIN s USING (sample_id)

-- name: r6_top_risks
SELECT sample_id, risk_score, risk_level
FROM r6_sample_risk
ORDER BY risk_score DESC, sample_id LIMIT 5

-- name: pair_sides
SELECT model_a AS model_name, disagreement_score
FROM p9_scored_pairs
UNION ALL SELECT model_b, disagreement_score
FROM p9_scored_pairs

-- name: model_pairs
SELECT model_name, 0.6e0 * max(disagreement_score) + 0.4e0 * avg(disagreement_score) AS pair_risk,
  avg(disagreement_score) AS mean_score, max(disagreement_score) AS peak_score
FROM pair_sides
GROUP BY model_name

-- name: model_parts
SELECT i.model_name, p.pair_risk, p.mean_score, p.peak_score, i.instability_score AS instability,
  1e0 - t.trust_contribution AS trust_deficit
FROM b4_model_instability i
LEFT JOIN model_pairs p ON i.model_name = p.model_name
LEFT JOIN d5_model_trust t ON i.model_name = t.model_name

-- name: r7_model_risk
SELECT model_name, round(mean_score, 6) AS mean_score, peak_score, instability, round(trust_deficit, 6) AS trust_deficit,
  round(coalesce((coalesce(0.4e0 * pair_risk, 0e0) + coalesce(0.4e0 * instability, 0e0) + coalesce(0.2e0 * trust_deficit,
  0e0)) / nullif(CASE WHEN pair_risk IS NULL THEN 0e0 ELSE 0.4e0 END + CASE WHEN instability IS NULL THEN 0e0 ELSE 0.4e0 END +
  CASE WHEN trust_deficit IS NULL THEN 0e0 ELSE 0.2e0 END, 0e0), 0.5e0), 6) AS risk_score
FROM model_parts

-- name: r8_risk_summary
SELECT count(*) AS samples, round(avg(risk_score), 6) AS mean_risk, max(risk_score) AS max_risk, min(risk_score) AS min_risk,
  round(median(risk_score), 6) AS median_risk, count(*) FILTER (WHERE risk_score >= 0.6e0) AS high_risk,
  count(*) FILTER (WHERE risk_score >= 0.8e0) AS critical_risk, round(avg(disagreement), 6) AS mean_disagreement,
  round(avg(confidence), 6) AS mean_confidence, round(avg(consensus), 6) AS mean_consensus, round(avg(instability),
  6) AS mean_instability, round(avg(fragility), 6) AS mean_fragility, round(avg(escalation), 6) AS mean_escalation
FROM r6_sample_risk

-- name: risk_levels
SELECT 'critical' AS risk_level
UNION ALL SELECT 'high'
UNION ALL SELECT 'moderate'
UNION ALL SELECT 'low'
UNION ALL SELECT 'minimal'

-- name: r8_levels
WITH c AS (SELECT v.risk_level, count(r.sample_id) AS samples FROM risk_levels v LEFT JOIN r6_sample_risk r ON v.risk_level = r.risk_level GROUP BY v.risk_level)
SELECT risk_level, samples, round(samples / (SELECT sum(samples) FROM c), 6) AS rate, samples > 0 AND risk_level = (SELECT risk_level FROM c ORDER BY samples DESC, risk_level LIMIT 1) AS most_common FROM c

-- name: r9_contributors
WITH s AS (SELECT unnest(string_split(secondary_factors, '|')) AS factor FROM r6_sample_risk WHERE secondary_factors <> '')
SELECT factor, coalesce(d.n, 0) AS dominant, coalesce(e.n, 0) AS secondary
FROM (SELECT dominant_factor AS factor, count(*) AS n FROM r6_sample_risk GROUP BY 1) d FULL JOIN (SELECT factor, count(*) AS n FROM s GROUP BY factor) e USING (factor)

-- name: kinds_of_samples
SELECT DISTINCT sample_id, 'perturbation_type' AS part, perturbation_type AS name FROM log UNION ALL SELECT DISTINCT sample_id, 'severity_level', severity_level FROM log

-- name: r10_fragility
WITH g AS (SELECT part, name, round(avg(risk_score), 6) AS mean_risk, max(risk_score) AS max_risk, min(risk_score) AS min_risk, round(max(risk_score) - min(risk_score), 6) AS delta, count(*) AS samples FROM kinds_of_samples JOIN r6_sample_risk USING (sample_id) GROUP BY part, name)
SELECT *, row_number() OVER (PARTITION BY part ORDER BY mean_risk DESC, name) AS place FROM g

-- name: r10_from_rates
WITH g AS (SELECT 'perturbation_type' AS part, perturbation_type AS name, disagreement_rate FROM b1_sensitivity UNION ALL SELECT 'severity_level', severity_level, disagreement_rate FROM b2_severity_rates)
SELECT *, row_number() OVER (PARTITION BY part ORDER BY disagreement_rate DESC, name) AS place FROM g

-- name: r11_model_risk_summary
SELECT max_by(model_name, risk_score) AS highest_risk, min_by(model_name, risk_score) AS most_stable, round(max(risk_score) - min(risk_score), 6) AS spread, count(*) FILTER (WHERE risk_score >= 0.6e0) AS high_risk_models,
  max_by(model_name, instability) AS fastest_destabilising, max_by(model_name, mean_score) AS top_contributor, coalesce(string_agg(model_name, '|' ORDER BY model_name) FILTER (WHERE risk_score >= 0.6), '') AS high_risk_names FROM r7_model_risk

-- name: r12_severity_trend
WITH c AS (SELECT name, mean_risk, CASE WHEN name IN ('clean', 'none', 'original') THEN 0 WHEN name = 'low' THEN 1 WHEN name = 'moderate' THEN 2 WHEN name = 'high' THEN 3 WHEN name = 'critical' THEN 4 ELSE 99 END AS k FROM r10_fragility WHERE part = 'severity_level'),
o AS (SELECT list(mean_risk ORDER BY k, name) AS v, max(mean_risk) AS top FROM c)
SELECT round(v[-1] - v[1], 6) AS delta, CASE WHEN v[-1] - v[1] > 0.02 THEN 'increasing' WHEN v[-1] - v[1] < -0.02 THEN 'decreasing' ELSE 'stable' END AS direction, top AS peak_rate, (SELECT min(name) FROM c WHERE mean_risk = top) AS peak_severity, v = list_sort(v) AS monotonic FROM o

-- name: r12_perturbations
SELECT name AS perturbation_type, mean_risk, row_number() OVER (ORDER BY mean_risk DESC, name) AS place, round(max(mean_risk) OVER () - min(mean_risk) OVER (), 6) AS spread FROM r10_fragility WHERE part = 'perturbation_type'

-- name: r12_models
SELECT model_name, risk_score, row_number() OVER (ORDER BY risk_score DESC, model_name) AS place, round(max(risk_score) OVER () - min(risk_score) OVER (), 6) AS spread FROM r7_model_risk

-- name: c1_consistency
SELECT j.model_name, count(*) AS perturbed, count(*) FILTER (WHERE NOT j.prediction_changed) AS kept, round(100e0 * count(*) FILTER (WHERE NOT j.prediction_changed) / count(*), 6) AS consistency_pct,
  bool_and(NOT j.prediction_changed) AND max(s.mean) > 0.95 AS saturated
FROM j2_against_clean j JOIN spread_of_models s USING (model_name) GROUP BY j.model_name

-- name: c1_flips
SELECT model_name, sample_id, perturbation_type, severity_level, clean_class, predicted_class
FROM j2_against_clean
WHERE prediction_changed

-- name: c3_sensitivity
SELECT model_name, sample_id, perturbation_type, severity_level, round(delta, 6) AS confidence_delta, flipped, CASE WHEN flipped THEN 'critical' WHEN delta > 0.05e0 THEN 'moderate' ELSE 'low' END AS severity FROM moved

-- name: c3_summary
WITH o AS (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY flipped DESC, round(delta, 6) DESC, perturbation_type DESC, severity_level DESC, sample_id DESC) AS top,
    row_number() OVER (PARTITION BY model_name ORDER BY flipped, round(delta, 6), perturbation_type, severity_level, sample_id) AS bottom
  FROM moved
)
SELECT model_name, count(*) AS perturbed, count(*) FILTER (WHERE flipped) AS flips, max(perturbation_type) FILTER (WHERE top = 1) AS most_sensitive, round(max(delta) FILTER (WHERE top = 1), 6) AS most_delta,
  max(perturbation_type) FILTER (WHERE bottom = 1) AS least_sensitive, round(max(delta) FILTER (WHERE bottom = 1), 6) AS least_delta
FROM o GROUP BY model_name

-- name: c5_weighting
WITH w(scheme, a, b, c, d) AS (VALUES ('Prior_30_30_20_20', 0.30e0, 0.30e0, 0.20e0, 0.20e0), ('Equal_25_25_25_25', 0.25e0, 0.25e0, 0.25e0, 0.25e0), ('Consistency_40_30_15_15', 0.40e0, 0.30e0, 0.15e0, 0.15e0), ('Calibration_20_20_30_30', 0.20e0, 0.20e0, 0.30e0, 0.30e0)),
s AS (SELECT scheme, model_name, round(a * consistency + b * stability + c * resistance + d * calibration, 2) AS score FROM scores_of_models, w),
p AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY score DESC, model_name) AS place FROM s)
SELECT p.scheme, p.model_name, p.score, p.place, x.place = y.place AS invariant
FROM p JOIN p x ON x.model_name = p.model_name AND x.scheme LIKE 'Prior%' JOIN p y ON y.model_name = p.model_name AND y.scheme LIKE 'Equal%'

-- name: c6_comparison
SELECT c.model_name, c.robustness_score, row_number() OVER (ORDER BY c.robustness_score DESC, c.model_name) AS place, round((SELECT max(robustness_score) FROM c4_robustness) - c.robustness_score, 6) AS gap,
  concat_ws('|', CASE WHEN s.consistency < 80 THEN 'unstable_predictions' END, CASE WHEN s.stability < 80 THEN 'unstable_confidence' END, CASE WHEN s.calibration < 90 THEN 'miscalibrated' END) AS diagnosis
FROM c4_robustness c JOIN scores_of_models s USING (model_name)

-- name: c18_degradation
WITH o AS (SELECT model_name, arg_max(confidence, seq) AS last FROM base GROUP BY model_name)
SELECT perturbation_type, round(avg(last - confidence), 6) AS mean_degradation, round(coalesce(stddev_samp(last - confidence), 0), 6) AS std_degradation, round(max(last - confidence), 6) AS max_degradation, count(*) AS n
FROM log JOIN o USING (model_name) WHERE severity_level NOT IN ('clean', 'none', 'original') GROUP BY perturbation_type

-- name: c18_experiment_summary
SELECT (SELECT count(*) FROM c6_comparison) AS models, (SELECT model_name FROM c6_comparison ORDER BY place LIMIT 1) AS most_robust, (SELECT model_name FROM c6_comparison ORDER BY place DESC LIMIT 1) AS least_robust,
  (SELECT round(avg(robustness_score), 6) FROM c6_comparison) AS mean_robustness, count(*) AS rows, round(avg(confidence), 6) AS mean_confidence, count(DISTINCT perturbation_type) AS types,
  (SELECT count(*) FROM j2_against_clean WHERE prediction_changed) AS flips
FROM log

-- name: c18_models
SELECT c.model_name, c.robustness_score, round(e.ece, 6) AS ece, (SELECT count(*) FROM log l WHERE l.model_name = c.model_name) AS rows FROM c4_robustness c JOIN error_of_models e USING (model_name)
