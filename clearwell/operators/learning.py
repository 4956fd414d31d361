"""Learning paths, grading and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START_SCORE = 100


def learning_paths(learners: DataFrame, lessons: DataFrame) -> DataFrame:
    """Lessons of each learner's role, or all lessons where the role has none.

    Lessons are a hand-written list, learners are not: a role's lessons are one array, learners are joined with the small
    table of roles, and the array is unfolded where the learner stands. No key is shared by all learners without
    lessons of their own.
    """
    entry = F.struct(*[F.col(c).alias("lesson_role" if c == "role" else c) for c in lessons.columns])
    own = lessons.groupBy("role").agg(F.collect_list(entry).alias("_own"))
    every = lessons.agg(F.collect_list(entry).alias("l")).select("l").scalar()
    chosen = learners.join(own, "role", "left").withColumn("_own", F.coalesce("_own", every))
    return chosen.select(*[c for c in learners.columns], F.inline("_own"))


def grade(submissions: DataFrame, lessons: DataFrame) -> DataFrame:
    """Points for exact answers, 0 for others, an error for unknown lessons: ``submissions(lesson_id, answer, …)``."""
    key = lessons.select(F.col("id").alias("lesson_id"), "correct_answer", "points", F.lit(True).alias("_known"))
    known, right = F.coalesce("_known", F.lit(False)), F.col("correct_answer").eqNullSafe(F.col("answer"))
    return (
        submissions.join(key, "lesson_id", "left")
        .withColumns({
            "status": F.when(known, F.lit("success")).otherwise(F.lit("error")),
            "correct": F.when(known, right),
            "points_awarded": F.when(known & right, F.col("points")).when(known, F.lit(0)),
            "explanation": F.when(known, F.concat(
                F.lit("The correct answer is '"), F.coalesce("correct_answer", F.lit("")), F.lit("'. "),
                F.when(right, F.lit("Excellent work!")).otherwise(F.lit("Review the lesson material and try again!")),
            )).otherwise(F.lit("Lesson not found")),
        })
        .drop("correct_answer", "points", "_known")
    )


def scores(graded: DataFrame, user: str = "user_id") -> DataFrame:
    """Start score plus all points awarded, per user."""
    points = F.coalesce(F.sum("points_awarded"), F.lit(0))
    return graded.groupBy(user).agg((F.lit(START_SCORE) + points).cast("bigint").alias("score"))
