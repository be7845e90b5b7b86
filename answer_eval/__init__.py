"""answer_eval: batch evaluation of labelled answers on Spark.

Problem tables x participants x answer logs -> graded rows -> reports, plus the
text, request, attempt-log and conversation operators around them.  Every public
function takes and returns a DataFrame or a Column.
"""

from answer_eval.session import configure, ensure_checkpoint_dir, get_session

__all__ = ["configure", "ensure_checkpoint_dir", "get_session"]
