"""FIXED VALUES of file admission: languages, skip lists and size bounds.

These tables must stay as they are, or results change.
"""

EXTENSION_LANGUAGE = {
    ".py": "python", ".pyw": "python", ".pyx": "python",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".ksh": "shell", ".csh": "shell",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "javascript", ".tsx": "javascript",
    ".ps1": "powershell", ".psm1": "powershell", ".psd1": "powershell",
    ".rb": "ruby", ".rake": "ruby",
    ".php": "php", ".phtml": "php",
    ".go": "go",
    ".pl": "perl", ".pm": "perl",
    ".yml": "config", ".yaml": "config", ".json": "config", ".toml": "config", ".ini": "config",
    ".cfg": "config", ".conf": "config",
    ".makefile": "shell", ".dockerfile": "shell",
}

FILENAME_LANGUAGE = {
    "Makefile": "shell", "Dockerfile": "shell", "Vagrantfile": "ruby", "Gemfile": "ruby",
    "Rakefile": "ruby", "Jenkinsfile": "shell", "Procfile": "shell",
    ".bashrc": "shell", ".bash_profile": "shell", ".zshrc": "shell", ".profile": "shell",
    "setup.py": "python", "setup.cfg": "config", "pyproject.toml": "config",
    "package.json": "config", ".env": "config", ".npmrc": "config",
}

# first hit wins: (words in the shebang line, language)
SHEBANG_LANGUAGE = [
    (["python"], "python"), (["bash", "sh", "zsh"], "shell"), (["node"], "javascript"),
    (["ruby"], "ruby"), (["perl"], "perl"), (["php"], "php"),
]
SHEBANG_CHARS = 256

SKIP_DIRECTORIES = [
    ".git", ".hg", ".svn", "__pycache__", "node_modules", ".tox", ".eggs", "*.egg-info",
    ".mypy_cache", ".pytest_cache", "venv", ".venv", "env", ".env_dir", "dist", "build", ".idea", ".vscode",
]
SKIP_DIRECTORY_SUFFIX = ".egg-info"

SKIP_FILES = [
    ".gitignore", ".gitattributes", ".editorconfig", "LICENSE", "LICENSE.md", "LICENSE.txt",
    "CHANGELOG.md", "CONTRIBUTING.md",
]

MAX_FILE_BYTES = 1_000_000
BINARY_SAMPLE_BYTES = 8192
BINARY_SHARE = 0.30
