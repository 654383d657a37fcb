"""SQL functions of a session, for those who write queries as text."""

DEFINITIONS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(seq STRING) RETURNS STRING RETURN translate(reverse(seq), 'ACGTacgt', 'TGCAtgca')",
    "CREATE OR REPLACE TEMPORARY FUNCTION canonical_motif(seq STRING) RETURNS STRING RETURN array_min(transform(sequence(1, greatest(length(seq), 1)), i -> substr(concat(seq, seq), i, length(seq))))",
    "CREATE OR REPLACE TEMPORARY FUNCTION motif_basis(seq STRING) RETURNS STRING RETURN array_join(array_sort(array_distinct(split(seq, ''))), '')",
    "CREATE OR REPLACE TEMPORARY FUNCTION variant_key(chrom STRING, pos INT, ref STRING, alts ARRAY<STRING>) RETURNS STRING RETURN concat(chrom, ':', pos, ':', concat_ws('/', concat(array(ref), alts)))",
    "CREATE OR REPLACE TEMPORARY FUNCTION allele_key(ref STRING, alts ARRAY<STRING>) RETURNS STRING RETURN concat_ws(',', concat(array(ref), array_sort(alts)))",
    "CREATE OR REPLACE TEMPORARY FUNCTION genotype_index(i INT, j INT) RETURNS INT RETURN CAST(greatest(i, j) * (greatest(i, j) + 1) / 2 AS INT) + least(i, j)",
    "CREATE OR REPLACE TEMPORARY FUNCTION vtype_name(vtype INT) RETURNS STRING RETURN CASE WHEN vtype = 0 THEN 'REF' ELSE concat_ws('/', IF(vtype & 1 <> 0, 'SNP', NULL), IF(vtype & 2 <> 0, 'MNP', NULL), IF(vtype & 4 <> 0, 'INDEL', NULL), IF(vtype & 8 <> 0, 'CLUMPED', NULL), IF(vtype & 16 <> 0, 'VNTR', NULL), IF(vtype & 32 <> 0, 'SV', NULL)) END",
)
