"""logweave — security-log analytics as Spark DataFrame jobs.

Raw log text becomes parsed, categorised and scored events through column
expressions; queries, reports, alert matching, detections and health grading
are DataFrame plans; the same functions run on Structured Streaming.
"""

__version__ = "0.1.0"
