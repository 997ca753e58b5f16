"""Fixed values of the candidate scoring domain: vocabularies, score maps and score weights."""

SKILL_VOCABULARY = [
    "Python", "Java", "JavaScript", "SQL", "Machine Learning", "Deep Learning",
    "Docker", "Kubernetes", "AWS", "Azure", "React", "Node.js", "TensorFlow",
    "PyTorch", "Git", "Linux", "CI/CD", "Agile", "REST APIs", "MongoDB",
    "Spark", "Kafka", "Terraform", "Ansible", "GraphQL", "Blockchain",
    "Cloud Computing", "DevOps", "Data Analysis", "Natural Language Processing",
    "Computer Vision", "Cybersecurity", "Network Security", "Microservices",
    "Scrum", "Jenkins", "Statistics", "R", "Tableau", "Power BI",
]

EDUCATION_LEVEL = {
    "High School": 1,
    "Certificate": 2,
    "Diploma": 3,
    "Bachelor's": 4,
    "Master's": 5,
    "PhD": 6,
}
EDUCATION_DEFAULT = 3

FIELD_SCORE = {
    "Computer Science": 1.0,
    "Software Engineering": 1.0,
    "Artificial Intelligence": 1.0,
    "Machine Learning": 1.0,
    "Information Technology": 0.9,
    "Data Science": 1.0,
    "Electrical Engineering": 0.70,
    "Electronics Engineering": 0.65,
    "Robotics": 0.75,
    "Cybersecurity": 0.85,
    "Mathematics": 0.70,
    "Statistics": 0.70,
    "Physics": 0.55,
    "Business Administration": 0.40,
    "Finance": 0.35,
    "Psychology": 0.25,
}
FIELD_DEFAULT = 0.45

TITLE_SCORE = {
    "Machine Learning Engineer": 1.00,
    "Data Scientist": 1.00,
    "Software Developer": 0.90,
    "Cloud Engineer": 0.90,
    "Cybersecurity Engineer": 0.85,
    "DevOps Engineer": 0.90,
    "Blockchain Engineer": 0.80,
    "Prompt Engineer": 0.80,
    "Project Manager": 0.65,
    "Quantum Computing Specialist": 0.75,
    "Data Analyst": 0.80,
    "Backend Developer": 0.88,
    "Frontend Developer": 0.82,
    "Full Stack Developer": 0.92,
    "Systems Engineer": 0.78,
}
TITLE_DEFAULT = 0.50

SKILL_CLUSTERS = {
    "ml_stack": [
        "Python", "Machine Learning", "Deep Learning", "TensorFlow", "PyTorch",
        "Natural Language Processing", "Computer Vision", "Statistics", "R",
    ],
    "cloud_stack": ["AWS", "Azure", "Cloud Computing", "Kubernetes", "Terraform", "Ansible", "Docker"],
    "data_stack": ["SQL", "MongoDB", "Spark", "Kafka", "Data Analysis", "Tableau", "Power BI", "Statistics"],
    "devops_stack": [
        "Docker", "Kubernetes", "CI/CD", "Jenkins", "Linux", "Git", "Ansible", "Terraform", "DevOps",
    ],
    "web_stack": ["JavaScript", "React", "Node.js", "REST APIs", "GraphQL"],
    "security": ["Cybersecurity", "Network Security", "Blockchain"],
}

SKILL_FLAGS = {
    "ml_flag": ["Machine Learning"],
    "cloud_flag": ["AWS", "Azure", "Cloud Computing"],
    "devops_flag": ["Docker", "Kubernetes", "CI/CD", "DevOps"],
    "data_flag": ["Data Analysis", "SQL", "Statistics"],
    "web_flag": ["JavaScript", "React", "Node.js"],
    "security_flag": ["Cybersecurity", "Network Security"],
}

CLASS_NAMES = ["Not Suitable", "Suitable"]

DEMO_NAMES = [
    "Priya Sharma", "Arjun Mehta", "Neha Gupta", "Rahul Das", "Zara Khan",
    "Dev Patel", "Ananya Singh", "Kiran Rao", "Aditya Verma", "Meera Nair",
]

DEMO_SKILL_BUNDLES = [
    "Python Machine Learning Deep Learning TensorFlow Docker AWS CI/CD",
    "JavaScript React Node.js REST APIs MongoDB Agile",
    "SQL Data Analysis Power BI Statistics Python R",
    "Java Spring Boot Microservices Docker Kubernetes Jenkins",
    "Cybersecurity Network Security Linux Ansible Terraform",
]
