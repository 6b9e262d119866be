"""Table schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values -------------------------------------------------------------
# Personality scores, primary factors first, then the global ones.
PRIMARY = ["A", "B", "C", "E", "F", "G", "H", "I", "L", "M", "N", "O", "Q1", "Q2", "Q3", "Q4"]
GLOBAL = ["EX", "AX", "TM", "IN", "SC"]
# Ability bands on the 1..10 scale of the scores.
BAND_SCALE = {"L": 2, "BA": 4, "A": 6, "AA": 8, "H": 10}
# Every band a sheet may hold; M has no place on the scale.
BANDS = ["A", "AA", "BA", "H", "L", "M"]
COURSES = ["BSCS", "BSIT"]
PASS_MARK = 3
GRADE_MAX = 5
CERT_MAX = 80
# Group score: passing grade, passing rate, certification.
SCORE_WEIGHTS = (0.5, 0.3, 0.2)
MIN_GROUP_SIZE = 3
TOP_GROUPS = 10
TOP_STUDENTS = 10
EXTREME_STUDENTS = 30
CONTRAST_PADDING = 0.1
# Label cuts on the 0..100 scale: below the first 0, below the second 1, to 100 2.
LABEL_CUTS = (50, 88)
LABEL_CUTS_OLD = (50, 85)
LABEL_CUTS_STRICT = (50, 95)
COHORT_TAG_RANGE = (2000, 3000)
NO_GRADE = "INC"
# Spellings of a group name and what they become, applied in this order.
NAME_RULES = [
    (r"(?i)^Un.*ty of Cebu.*", "UNIVERSITY OF CEBU"),
    (r"(?i)^Un.*ty of San Carlos.*", "UNIVERSITY OF SAN CARLOS"),
    (r"(?i)^Un.*ty of San Jose.*", "UNIVERSITY OF SAN JOSE RECOLETOS"),
]
# Sheet headings.
ID_HEADING = "ID Number"
CERT_ID_HEADING = "ID No."
GROUP_HEADING = "Previous School"
COURSE_HEADING = "Course"
BAND_HEADING = "CFIT"
CERT_HEADING = "C Certification"
GRADE_HEADING = "Final Grades"
PROFILE_SCORE_POSITION = 7
SCORING_SCORE_POSITION = 6
# --------------------------------------------------------------------------

ATTRIBUTES = PRIMARY + GLOBAL
ATTR_COLS = [f"attr_{a}" for a in ATTRIBUTES]
COURSE_COLS = [f"course_{c.lower()}" for c in COURSES]
BAND_COLS = [f"cfit_{b}" for b in BANDS]

# Feature vector order, shared by training and scoring: names in lexicographic
# order inside each prefix, prefixes attr < cfit < course < the three base scores.
FEATURES = sorted(ATTR_COLS) + BAND_COLS + COURSE_COLS
BASE_SCORES = ["fail", "pass", "success"]
STACK_FEATURES = FEATURES + BASE_SCORES

GROUPS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
])
COHORTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType()),
])
STUDENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("student_key", T.StringType()),
    T.StructField("group_id", T.LongType()),
    T.StructField("cohort_id", T.LongType()),
    T.StructField("course", T.StringType()),
    T.StructField("training", T.ByteType()),
])
ASSESSMENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("student_id", T.LongType()),
        T.StructField("cfit", T.StringType()),
    ]
    + [T.StructField(c, T.IntegerType()) for c in ATTR_COLS]
    + [T.StructField("c_cert", T.IntegerType()), T.StructField("grade", T.DoubleType())]
)
