"""Fixed values of the hiring process: stages, allowed transitions, labels and the interview calendar."""

STAGES = ["applied", "shortlisted", "interview_scheduled", "interviewed", "selected", "rejected"]

TRANSITIONS = {
    "applied": ["shortlisted", "rejected"],
    "shortlisted": ["interview_scheduled", "rejected"],
    "interview_scheduled": ["interviewed", "rejected"],
    "interviewed": ["selected", "rejected"],
    "selected": [],
    "rejected": ["shortlisted"],
}

NOT_IN_PROCESS = "not_in_pipeline"

STATUS_LABELS = {
    "applied": "🔵 applied",
    "shortlisted": "🟣 shortlisted",
    "interview_scheduled": "🟡 interview_scheduled",
    "interviewed": "🟠 interviewed",
    "selected": "🟢 selected",
    "rejected": "🔴 rejected",
    "not_in_pipeline": "⚪ not in pipeline",
}

PRIORITY_LABELS = {"high": "🚨 HIGH", "medium": "⚠️ MEDIUM", "low": "📋 LOW", "none": "✅ NONE"}

INTERVIEW_TIMES = ["09:00", "11:00", "14:00", "16:00"]
INTERVIEW_DAYS_AHEAD = 7
