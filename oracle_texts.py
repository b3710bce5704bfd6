"""Texts of results, written out once more so that the SQL does not share them with the code.

Fixed values: they are what results are compared on.
"""

AFTER_HOURS_REASON = 'posted outside business hours (%d:00-%d:00)'
BENFORD_REASON = "Benford's Law: leading digit over-represented vs. expected distribution"
CLEAN_TIE_OUT = 'Clean tie-out'
CLOSED_LOAN = 'Closed loan — fully repaid, correctly excluded from schedule'
DISBURSEMENT_ACCOUNT = 'Loan Disbursement'
DUPLICATE_GROUP_PREFIX = 'DUP-GRP-'
DUPLICATE_ID_REASON = 'Duplicate transaction_id — data integrity issue'
DUPLICATE_PAYMENT_REASON = 'Potential duplicate payment: same counterparty, account, and amount within %s day(s)'
FUZZY_REASON_HEAD = "Possible related party: counterparty name closely resembles staff member '"
FUZZY_REASON_MIDDLE = "' (similarity "
FUZZY_REASON_TAIL = ') — review recommended, not a confirmed match'
GHOST_LOAN = 'Unsupported schedule entry — no GL support (possible ghost loan)'
MATERIAL_VARIANCE = 'Material variance — investigate'
MISSING_KEY_TEXT = 'nan'
NONCONFORMITY = 'Nonconformity — investigate further'
OUTLIER_METHOD_NAMES = {'iqr': 'IQR method', 'modified_zscore': 'modified z-score', 'zscore': 'classic z-score'}
NEAR_MATCH = 'Near match'
OUTLIER_REASON_HEAD = "Statistical outlier (%s) within '"
OUTLIER_REASON_MIDDLE = "' — "
OUTLIER_REASON_TAIL = ' extreme relative to peer transactions'
RECONCILIATION_ORDER = ['Unsupported schedule entry — no GL support (possible ghost loan)',
 'Unsupported GL balance — missing from schedule',
 'Material variance — investigate',
 'Timing difference — monitor',
 'Clean tie-out',
 'Closed loan — fully repaid, correctly excluded from schedule']
RELATED_PARTY_REASONS = {'Self-dealing': 'Related party: counterparty matches the SAME officer who posted this '
                 'transaction (possible self-dealing / control bypass)',
 'Staff as borrower': "Related party: counterparty name matches a staff member's name "
                      '(disclosure required, not necessarily improper)'}
REPAYMENT_ACCOUNT = 'Loan Repayment'
ROUND_REASON_HEAD = 'Round-number transaction: '
ROUND_REASON_TAIL = ' — atypical for organically-occurring amounts, common in estimated/fabricated entries'
SAMPLE_SIZE_WARNING = ("Sample size (n=%d) is below Nigrini's recommended minimum of %d for the first-digit test. "
 'Treat results as indicative only — deviations may reflect sampling noise rather than '
 'genuine anomalies.')
SELF_DEALING = 'Self-dealing'
STAFF_AS_BORROWER = 'Staff as borrower'
TIMING_DIFFERENCE = 'Timing difference — monitor'
TIMING_REASON_HEAD = 'Journal entry timing: '
UNSUPPORTED_GL = 'Unsupported GL balance — missing from schedule'
WEEKEND_REASON = 'posted on a weekend'
