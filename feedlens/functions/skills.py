"""The skill catalog: names by category, the rule that makes keywords of a name, and the names that prose uses as words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

# Categories and skill names in their order of display.
NAMES = {
    "Languages": ["Python", "JavaScript", "TypeScript", "Java", "C", "C++", "C#", "Go", "Rust", "Swift", "Kotlin", "Ruby", "PHP", "Scala", "SQL", "R", "MATLAB", "Shell / Bash"],
    "Frontend": ["React", "Next.js", "Vue", "Angular", "Svelte", "HTML / CSS", "Tailwind CSS", "Redux", "Web Accessibility", "WebGL", "Webpack / Vite"],
    "Mobile": ["Android", "iOS", "SwiftUI", "Jetpack Compose", "React Native", "Flutter", "App Store Release"],
    "Backend & APIs": ["Node.js", "Express", "Django", "Flask", "FastAPI", "Spring Boot", ".NET", "Ruby on Rails", "REST APIs", "GraphQL", "gRPC", "Microservices", "WebSockets", "Message Queues"],
    "Data & Databases": ["PostgreSQL", "MySQL", "MongoDB", "Redis", "SQLite", "Elasticsearch", "Apache Spark", "Kafka", "ETL / Pipelines", "Snowflake", "BigQuery", "dbt", "Pandas", "Airflow"],
    "AI / ML": ["PyTorch", "TensorFlow", "scikit-learn", "Deep Learning", "NLP", "Computer Vision", "LLMs", "RAG", "Hugging Face", "MLOps", "Reinforcement Learning"],
    "Cloud & DevOps": ["AWS", "Azure", "GCP", "Docker", "Kubernetes", "Terraform", "CI/CD", "GitHub Actions", "Jenkins", "Linux", "Nginx", "Serverless", "Observability", "Ansible"],
    "Systems & Low-level": ["Operating Systems", "Compilers", "Embedded / Firmware", "Concurrency", "Networking", "Memory Management", "Assembly", "FPGA / Verilog", "Robotics / ROS", "Real-time Systems"],
    "Security": ["Application Security", "Cryptography", "Penetration Testing", "Threat Modeling", "OAuth / Identity", "Reverse Engineering", "Incident Response", "Secure Code Review"],
    "Tools & Practices": ["Git", "Agile / Scrum", "Code Review", "Unit Testing", "Integration Testing", "TDD", "Debugging", "System Design", "Data Structures & Algorithms", "Technical Writing", "Jira", "Figma"],
}

# Keywords that alone count in long text for names that are also ordinary words.
AMBIGUOUS = {
    "Go": ["golang", " go/", "go programming"],
    "C": [" c/", "c99", "c11", "c programming"],
    "R": ["rstudio", "tidyverse", " r/", "r programming"],
    "RAG": ["retrieval-augmented", "vector database", "embeddings"],
}

#: Parts of a name with at most so many letters are words of their own, not parts of others.
SHORT = 5


def keywords_of(name: str) -> list[str]:
    """Keywords by rule: each part of the name between slashes; short ones with a blank on both sides, which asks for a word boundary.

    A part that ends in .js is also known without the point.
    """
    found = []
    for part in re.split(" / ", name.lower()):
        found.append(f" {part} " if len(part) <= SHORT and part[-1].isalnum() else part)
        if part.endswith(".js"):
            found += [f"{part[:-3]}js", f"{part[:-3]} js"]
    return found


@dataclass(frozen=True)
class Catalog:
    """(name, category, keywords) in order, and tighter keywords by name for long text."""

    skills: Sequence[tuple[str, str, Sequence[str]]]
    tight: dict[str, Sequence[str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [name for name, _, _ in self.skills]

    def with_keywords(self, more: dict[str, Iterable[str]]) -> Catalog:
        """The catalog with further keywords of some names."""
        return Catalog([(n, c, [*words, *more.get(n, ())]) for n, c, words in self.skills], self.tight)


def default_catalog() -> Catalog:
    """The names above with the keywords of the rule."""
    return Catalog([(n, c, keywords_of(n)) for c, names in NAMES.items() for n in names], AMBIGUOUS)
