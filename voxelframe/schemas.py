"""Schemas of the records that pass between stages."""

from __future__ import annotations

from pyspark.sql import types as T

LABELS = T.MapType(T.StringType(), T.ByteType(), True)



MANIFEST = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("sample_id", "patient_id", "study_id", "image_id", "image_path", "source_format")]
    + [T.StructField(n, T.StringType()) for n in ("modality", "view_position", "laterality", "photometric_interpretation")]
    + [T.StructField(n, T.LongType()) for n in ("width", "height")]
    + [T.StructField(n, T.StringType()) for n in ("series_instance_uid", "sop_instance_uid", "transfer_syntax_uid", "pixel_hash")]
    + [T.StructField("labels", LABELS, False)]
    + [T.StructField(n, T.StringType()) for n in ("label_source", "report_path", "split", "sha256")]
)

WARNINGS = T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType())]))

INVENTORY = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("path", "sha256", "transfer_syntax_uid")]
    + [T.StructField(n, T.StringType()) for n in ("patient_id", "study_instance_uid", "series_instance_uid", "sop_instance_uid", "modality", "body_part_examined", "view_position", "laterality", "pixel_representation", "photometric_interpretation", "pixel_hash", "decoder_backend", "decoder_version")]
    + [T.StructField(n, T.IntegerType()) for n in ("rows", "columns", "samples_per_pixel", "bits_allocated", "bits_stored", "high_bit")]
    + [T.StructField(n, T.ArrayType(T.FloatType())) for n in ("pixel_spacing", "imager_pixel_spacing")]
    + [T.StructField(n, T.FloatType()) for n in ("rescale_intercept", "rescale_slope", "window_center", "window_width")]
    + [T.StructField("warnings", WARNINGS)]
)

PATCH = T.StructType(
    [
        T.StructField("index", T.LongType()), T.StructField("case_id", T.StringType()), T.StructField("patch_start", T.ArrayType(T.IntegerType())),
        T.StructField("patch_size", T.ArrayType(T.IntegerType())), T.StructField("has_foreground", T.BooleanType()), T.StructField("strategy", T.StringType()),
        T.StructField("epoch", T.LongType()), T.StructField("worker", T.LongType()),
    ]
)

BOX = T.StructType([T.StructField("label", T.StringType()), T.StructField("label_id", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in ("x", "y", "width", "height", "x1", "y1", "x2", "y2", "image_width", "image_height", "area_fraction", "width_fraction", "height_fraction", "center_x_fraction", "center_y_fraction")])
