"""Record shapes, in the order in which exports list their fields."""

from pyspark.sql import types as T


def _texts(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


TEXT_LIST = T.ArrayType(T.StringType())

PERSONAL_INFO = _texts("name email phone location linkedin portfolio")
EXPERIENCE = _texts("title company location duration description")
EDUCATION = _texts("degree institution location year gpa")
CERTIFICATION = _texts("name issuer date expiry")
PROJECT = T.StructType(
    [
        *_texts("name description").fields,
        T.StructField("technologies", TEXT_LIST),
        T.StructField("duration", T.StringType()),
    ]
)
LANGUAGE = _texts("language proficiency")

ARRAY_FIELDS = {
    "skills": TEXT_LIST,
    "experience": T.ArrayType(EXPERIENCE),
    "education": T.ArrayType(EDUCATION),
    "certifications": T.ArrayType(CERTIFICATION),
    "projects": T.ArrayType(PROJECT),
    "languages": T.ArrayType(LANGUAGE),
    "awards": TEXT_LIST,
}

# What a model is asked to answer.
ANSWER = T.StructType(
    [
        T.StructField("personal_info", PERSONAL_INFO),
        T.StructField("summary", T.StringType()),
        *(T.StructField(name, dtype) for name, dtype in ARRAY_FIELDS.items()),
    ]
)

# A stored record: the answer and what is known about the call.
CANDIDATE = T.StructType(
    [
        *ANSWER.fields,
        T.StructField("filename", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("text_length", T.IntegerType()),
        *_texts("provider model error raw_response").fields,
    ]
)

# fit_percentage arrives as a number, a numeric text or a text with a percent sign.
FIT_ANSWER = T.StructType(
    [
        *_texts("summary fit_percentage").fields,
        T.StructField("key_matches", TEXT_LIST),
        T.StructField("key_gaps", TEXT_LIST),
    ]
)
FIT_REQUIRED = ["summary", "fit_percentage", "key_matches", "key_gaps"]

USAGE = T.StructType([*_texts("provider model day").fields, T.StructField("calls", T.LongType())])
LEDGER = "map<string,map<string,map<string,bigint>>>"

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
