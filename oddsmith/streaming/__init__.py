from oddsmith.streaming.scoring import append_scores, score_stream

__all__ = ["append_scores", "score_stream"]
