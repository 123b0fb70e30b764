"""Feature packs for languages, frameworks, architecture, DevOps and cloud skills."""

from __future__ import annotations

# Per language the suffixes, (pattern, weight) pairs and level words in order.
LANGUAGES = {
    "Python": {
        "suffixes": (".py",),
        "patterns": [
            (r"\bimport\s+\w+", 0.7), (r"\bfrom\s+\w+\s+import", 0.7), (r"def\s+\w+\s*\(", 0.5),
            (r"class\s+\w+:", 0.5), (r"if\s+__name__\s*==", 0.8), (r"print\s*\(", 0.3),
            (r"self\.", 0.6), (r"@decorator", 0.5),
        ],
        "levels": [
            ("async def", "advanced"), ("yield", "intermediate"),
            ("typing.Optional", "intermediate"), ("dataclass", "intermediate"),
            ("abc.ABC", "advanced"), ("metaclass", "expert"),
        ],
    },
    "JavaScript": {
        "suffixes": (".js", ".jsx", ".mjs"),
        "patterns": [
            (r"\bconst\s+\w+\s*=", 0.6), (r"\blet\s+\w+\s*=", 0.6), (r"function\s+\w+\s*\(", 0.5),
            (r"=>", 0.5), (r"console\.log", 0.4), (r"require\s*\(", 0.6),
            (r"module\.exports", 0.7), (r"async\s+function", 0.5), (r"\.then\s*\(", 0.4),
        ],
        "levels": [
            ("async/await", "intermediate"), ("Promise", "intermediate"),
            ("generator", "advanced"), ("Proxy", "advanced"), ("Symbol", "advanced"),
        ],
    },
    "TypeScript": {
        "suffixes": (".ts", ".tsx"),
        "patterns": [
            (r":\s*(?:string|number|boolean|any)\b", 0.7), (r"interface\s+\w+", 0.7),
            (r"type\s+\w+\s*=", 0.7), (r"<\w+>", 0.5), (r"as\s+\w+", 0.5),
            (r"\benum\s+\w+", 0.6), (r"readonly\s+\w+", 0.6),
        ],
        "levels": [
            ("Generic<>", "intermediate"), ("keyof", "advanced"), ("Partial<", "advanced"),
            ("readonly", "intermediate"), ("strict", "advanced"),
        ],
    },
    "Java": {
        "suffixes": (".java",),
        "patterns": [
            (r"public\s+class\s+\w+", 0.8), (r"public\s+static\s+void\s+main", 0.9),
            (r"System\.out\.println", 0.7), (r"@Override", 0.6), (r"extends\s+\w+", 0.5),
            (r"implements\s+\w+", 0.5), (r"new\s+\w+\[\]", 0.4),
        ],
        "levels": [
            ("synchronized", "intermediate"), ("@Entity", "advanced"),
            ("@Transactional", "advanced"), ("CompletableFuture", "advanced"),
            ("Stream<>", "intermediate"),
        ],
    },
    "Go": {
        "suffixes": (".go",),
        "patterns": [
            (r"package\s+\w+", 0.9), (r"func\s+\w+\s*\(", 0.7), (r"go\s+func", 0.8),
            (r"defer\s+", 0.6), (r"chan\s+\w+", 0.7), (r"goroutine", 0.8),
            (r"interface\s*\{", 0.5),
        ],
        "levels": [
            ("go func", "intermediate"), ("chan", "advanced"), ("select", "advanced"),
            ("defer", "intermediate"), ("goroutine", "advanced"),
        ],
    },
    "Rust": {
        "suffixes": (".rs",),
        "patterns": [
            (r"fn\s+\w+\s*\(", 0.7), (r"let\s+mut\s+", 0.6), (r"impl\s+\w+", 0.6),
            (r"pub\s+fn", 0.5), (r"->.*\{", 0.5), (r"&\w+", 0.4), (r"Option<", 0.6),
            (r"Result<", 0.6),
        ],
        "levels": [
            ("unsafe", "advanced"), (" lifetimes", "expert"), ("trait", "advanced"),
            ("Box<>", "intermediate"), ("Rc<>", "advanced"),
        ],
    },
    "C": {
        "suffixes": (".c", ".h"),
        "patterns": [
            (r"#include\s*<", 0.8), (r"int\s+main\s*\(", 0.9), (r"printf\s*\(", 0.7),
            (r"scanf\s*\(", 0.7), (r"malloc\s*\(", 0.6), (r"free\s*\(", 0.6),
            (r"struct\s+\w+", 0.5),
        ],
        "levels": [
            ("malloc/free", "intermediate"), ("pointer", "intermediate"),
            ("bitwise", "intermediate"),
        ],
    },
    "C++": {
        "suffixes": (".cpp", ".hpp", ".cc"),
        "patterns": [
            (r"#include\s*<iostream>", 0.7), (r"std::", 0.6), (r"class\s+\w+\s*:\s*public", 0.6),
            (r"template\s*<", 0.7), (r"virtual\s+", 0.5), (r"new\s+\w+\[", 0.5),
            (r"nullptr", 0.5),
        ],
        "levels": [
            ("template", "advanced"), ("virtual", "intermediate"), ("STL", "intermediate"),
            ("move semantics", "advanced"),
        ],
    },
}
LANGUAGE_THRESHOLD = 1.5

# Framework → (words in the text, words in the path).
FRAMEWORKS = {
    "Django": (["django"], ["urls.py", "settings.py"]),
    "Flask": (["flask"], []),
    "FastAPI": (["fastapi"], []),
    "Express": (["express"], []),
    "NestJS": (["@nestjs"], []),
    "Spring": (["org.springframework"], []),
    "Spring Boot": (["spring.boot"], []),
    "Gin": (["github.com/gin-gonic"], []),
    "Echo": (["github.com/labstack/echo"], []),
    "Axum": (["tokio::sync"], []),
    "React": (["react"], [".jsx", ".tsx"]),
    "Vue": (["vue"], [".vue"]),
    "Angular": (["@angular"], []),
    "Next.js": (["next"], ["next.config"]),
    "Nuxt": (["nuxt"], []),
    "Svelte": (["svelte"], []),
    "Pandas": (["pandas", "pd"], []),
    "NumPy": (["numpy", "np"], []),
    "TensorFlow": (["tensorflow", "tf"], []),
    "PyTorch": (["torch"], []),
    "Scikit-learn": (["sklearn"], []),
    "SQLAlchemy": (["sqlalchemy"], []),
    "Django ORM": (["django.db"], []),
    "Prisma": (["@prisma"], []),
    "TypeORM": (["typeorm"], []),
    "Mongoose": (["mongoose"], []),
    "Sequelize": (["sequelize"], []),
    "pytest": (["pytest"], []),
    "Jest": (["jest"], []),
    "Mocha": (["mocha"], []),
    "JUnit": (["org.junit"], []),
    "Docker": ([], ["Dockerfile", "docker-compose.yml"]),
    "Kubernetes": ([], ["k8s", "kubernetes"]),
    "Git": ([], [".gitignore"]),
    "CI/CD": ([], [".github/workflows", "Jenkinsfile", ".gitlab-ci.yml"]),
}

# Architecture pattern → words, two of which must occur.
ARCHITECTURES = {
    "REST API": ["GET", "POST", "PUT", "DELETE", "@app.route", "@router", "@RequestMapping"],
    "GraphQL": ["graphql", "schema", "query", "mutation", "@Query", "@Mutation"],
    "Microservices": ["docker", "kubernetes", "grpc", "service mesh"],
    "MVC": ["Model", "View", "Controller", "model", "view", "controller"],
    "MVVM": ["ViewModel", "observable", "@observable"],
    "Clean Architecture": ["entity", "usecase", "repository", "interface adapter"],
    "CQRS": ["Command", "Query", "EventHandler", "CommandHandler"],
    "Event-Driven": ["Event", "emit", "on(", "addEventListener", "subscribe"],
    "Observer Pattern": ["Observer", "Subject", "notify", "listener"],
    "Factory Pattern": ["Factory", "create(", "Builder", "@Builder"],
    "Singleton Pattern": ["getInstance", "singleton", "static instance"],
}

# DevOps tool → (words in the path, words in the text).
DEVOPS = {
    "Docker": (["Dockerfile", "docker-compose.yml", "docker-compose.yaml"],
               ["FROM", "RUN docker", "docker build"]),
    "Kubernetes": (["k8s/", ".k8s/", "deployment.yaml", "service.yaml"],
                   ["apiVersion:", "kind:", "kubectl"]),
    "CI/CD": ([".github/workflows", "Jenkinsfile", ".gitlab-ci.yml", ".circleci/config.yml"],
              ["github_actions", "workflow_dispatch", "pipelines:"]),
    "Terraform": ([".tf", "terraform.tfvars"], ['resource "', 'provider "', "terraform init"]),
    "AWS": ([], ["aws_", "s3://", "arn:aws:"]),
    "Azure": ([], ["azure-", "@azure/"]),
}

# Cloud-native group → lower-case words.
CLOUD = {
    "containers": ["docker", "containerd", "podman"],
    "orchestration": ["kubernetes", "docker-swarm", "nomad"],
    "service_mesh": ["istio", "linkerd", "envoy"],
    "serverless": ["lambda", "cloudfunctions", "azure-functions"],
    "cicd": ["github-actions", "gitlab-ci", "jenkins", "travis", "circleci"],
}

# Kind → (category, level or None, confidence, description, evidence).
KINDS = {
    "languages": ("编程语言", None, 0.8, "{name}编程能力", "通过{path}识别"),
    "frameworks": ("框架/库", "intermediate", 0.7, "使用{name}框架/库进行开发", "检测到{name}导入或配置"),
    "architectures": ("架构模式", "advanced", 0.6, "应用{name}架构模式", "检测到{name}特征"),
    "devops": ("DevOps工具", "intermediate", 0.7, "使用{name}进行运维和部署", "检测到{name}配置文件"),
    "cloud": ("云原生", "advanced", 0.6, "具备{name}云原生技术能力", "检测到云原生技术特征"),
}
