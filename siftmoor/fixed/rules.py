"""The default rule catalogue.

FIXED VALUES: ids, names, categories, severities, weights, languages, technique
ids and match patterns must stay as they are, or results change.

One rule per paragraph.  Header:

    id | name | category/subcategory | severity weight | languages | technique

then one pattern per line, ``re`` for a regular expression and ``lit`` for a
literal (matched character by character, backslashes included).  Rules stand in
catalogue order; that order is a tie-break when findings are merged.
"""

RULES = r"""
# crypto mining
MINE-PROTO-001 | Stratum Mining Protocol | impact/cryptomining | critical 85 | all | T1496
  lit stratum\+tcp://
  lit stratum\+ssl://
MINE-POOL-001 | Mining Pool Domain Connection | impact/cryptomining | critical 85 | all | T1496
  lit pool\.minexmr\.com
  lit pool\.supportxmr\.com
  lit nanopool\.org
  lit hashvault\.pro
  lit 2miners\.com
  lit herominers\.com
MINE-BIN-001 | Mining Binary Download | impact/cryptomining | critical 90 | all | T1496
  lit xmrig
  lit cpuminer
  lit bfgminer
  lit cgminer
  lit minerd
MINE-HASH-001 | Hash Rate / Mining References | impact/cryptomining | high 65 | all | T1496
  lit hashrate
  lit hash_rate
  lit hashes_per_second
  lit RandomX
MINE-COINHIVE-001 | Browser Mining Script | impact/browser_mining | critical 85 | javascript | T1496
  lit CoinHive
  lit coinhive\.min\.js
  lit deepMiner
  lit cryptonight\.wasm
MINE-WALLET-001 | Cryptocurrency Wallet Addresses | impact/cryptomining | medium 55 | all | T1496
  re \b4[0-9A-Za-z]{94}\b
  re \bbc1q[a-z0-9]{38,}\b
  re \b0x[0-9a-fA-F]{40}\b

# exfiltration
EXFIL-WEBHOOK-001 | Discord Webhook Exfiltration | exfiltration/webhook | critical 85 | all | T1567
  lit discord\.com/api/webhooks
  lit discordapp\.com/api/webhooks
EXFIL-WEBHOOK-002 | Slack Webhook Exfiltration | exfiltration/webhook | high 80 | all | T1567
  lit hooks\.slack\.com/services
EXFIL-WEBHOOK-003 | Telegram Bot Exfiltration | exfiltration/webhook | critical 85 | all | T1102
  lit api\.telegram\.org/bot
EXFIL-EMAIL-001 | SMTP Email Exfiltration | exfiltration/email | high 75 | python | T1048.003
  lit smtplib\.SMTP
  re smtp\.sendmail
  lit MIMEMultipart
EXFIL-FTP-001 | FTP Upload Exfiltration | exfiltration/ftp | high 70 | python,shell | T1048
  lit ftplib\.FTP
  re ftp\.storbinary
  re ftp\s+-n.*<<.*put
EXFIL-PASTE-001 | Pastebin Data Upload | exfiltration/paste_site | high 80 | all | T1567
  lit pastebin\.com/api
  lit hastebin\.com
  lit paste\.ee
EXFIL-CRED-001 | Credential Harvest + Send | exfiltration/credential_exfil | critical 95 | all | T1041
  re password.*requests\.post
  re credentials.*send
  re Login Data.*requests
EXFIL-SCREEN-001 | Screenshot + Send | exfiltration/screen_exfil | critical 85 | python | T1113
  re screenshot.*send
  re ImageGrab.*post
  re pyautogui.*upload
EXFIL-SYS-001 | System Info Collection + Send | exfiltration/recon_exfil | high 70 | python,powershell,shell | T1082
  re platform\.uname.*requests\.post
  re getlogin.*send
  re hostname.*curl

# javascript
JS-EXEC-001 | eval() Dynamic Execution | execution/dynamic_code | critical 80 | javascript | T1059.007
  re eval\s*\(
JS-EXEC-002 | Function Constructor Code Execution | execution/dynamic_code | critical 80 | javascript | T1059.007
  re new\s+Function\s*\(
JS-PROC-001 | child_process.exec() Shell Command | execution/shell_command | critical 85 | javascript | T1059
  re child_process.*exec\s*\(
  re require\s*\(['"]child_process['"]\)
JS-PROC-002 | child_process.execSync() | execution/shell_command | critical 85 | javascript | T1059
  re execSync\s*\(
JS-COOKIE-001 | document.cookie Access | credential_access/cookie_theft | high 65 | javascript | T1539
  lit document\.cookie
JS-NET-001 | fetch() Data Exfiltration | exfiltration/http_exfil | medium 55 | javascript | T1041
  re fetch\s*\([^)]*method\s*:\s*['"]POST['"]
JS-KEY-001 | Browser Keylogger | collection/keylogging | critical 85 | javascript | T1056.001
  re addEventListener\s*\(['"]key(down|press|up)['"]
JS-CLIP-001 | Clipboard Access | collection/clipboard | high 70 | javascript | T1115
  lit navigator\.clipboard\.readText
  lit clipboard\.readText
JS-NPM-001 | npm Lifecycle Hook Script | execution/supply_chain | high 75 | javascript | T1059.007
  re "preinstall"\s*:
  re "postinstall"\s*:
  re "install"\s*:
JS-NPM-002 | Base64 Decoded Eval (Encoded Payload) | obfuscation/encoded_payload | critical 90 | javascript | T1027
  re Buffer\.from\s*\([^)]+,\s*['"]base64['"]\)
  re atob\s*\(.*eval
JS-ENV-001 | process.env Access (Environment Variables) | credential_access/env_secrets | low 40 | javascript | T1552.001
  re process\.env\.
JS-FS-001 | Sensitive File Read (Node.js) | credential_access/file_access | high 70 | javascript | T1005
  re fs\.readFile.*(\.ssh|/etc/passwd|credentials|id_rsa)
  re readFileSync.*(\.ssh|/etc/shadow|AWS)
JS-CAM-001 | Camera Access via getUserMedia | collection/camera | critical 80 | javascript | T1125
  re getUserMedia\s*\(.*video
  lit getDisplayMedia
JS-MIC-001 | Microphone Access via getUserMedia | collection/microphone | critical 80 | javascript | T1123
  re getUserMedia\s*\(.*audio
JS-WEBSOCKET-001 | WebSocket C2 Connection | network/c2_channel | medium 50 | javascript | T1071
  re new\s+WebSocket\s*\(

# network
NET-REV-001 | Generic Reverse Shell Pattern | network/reverse_shell | critical 90 | all | T1059
  re /bin/sh.*socket
  re /bin/bash.*connect
NET-PORT-001 | Known C2 Port Usage | network/c2_port | medium 55 | all | T1071
  re \b(4444|5555|1337|31337|6666|6667|9001|4443)\b
NET-STRAT-001 | Cryptocurrency Mining Protocol | impact/crypto_mining | critical 85 | all | T1496
  lit stratum\+tcp://
  lit stratum\+ssl://
NET-DNS-001 | DNS Tunneling Pattern | network/dns_tunneling | high 75 | all | T1071.004
  re dns.*tunnel
  lit dnscat
  lit iodine
NET-TOR-001 | Tor Network Connection | network/anonymization | medium 65 | all | T1090
  lit \.onion
  re socks5.*127\.0\.0\.1.*9050
  lit torify
NET-EXFIL-001 | Large Data Upload Pattern | exfiltration/data_upload | medium 60 | all | T1041
  re requests\.post.*files
  re urllib.*upload
NET-NGROK-001 | Ngrok Tunnel (Expose Local Server) | network/tunneling | medium 55 | all | T1572
  lit ngrok
  lit pyngrok
NET-IRC-001 | IRC Bot Pattern | network/irc_bot | high 70 | all | T1071
  re irc\.connect
  re PRIVMSG.*#

# obfuscation
OBF-B64-001 | Base64 Decode + Execute Chain | obfuscation/encoded_execution | critical 90 | python,javascript,powershell,shell | T1027
  re b64decode.*exec
  re base64.*decode.*eval
  re FromBase64String.*Invoke
OBF-B64-002 | Base64 Decode (Standalone) | obfuscation/encoding | low 20 | python,javascript,powershell,shell | T1027
  lit base64\.b64decode
  lit base64\.decode
OBF-MARSH-001 | marshal.loads + exec (Binary Code Object) | obfuscation/code_object | critical 95 | python | T1027.002
  lit marshal\.loads
  re exec.*marshal\.loads
OBF-ZLIB-001 | zlib Decompress + Execute | obfuscation/compressed_payload | critical 85 | python | T1027
  re zlib\.decompress.*exec
  re exec.*zlib\.decompress
OBF-HEX-001 | Hex-Encoded Payload Execution | obfuscation/hex_encoding | critical 85 | python | T1027
  re bytes\.fromhex.*exec
  re exec.*bytes\.fromhex
  re \\x[0-9a-fA-F]{2}.*exec
OBF-CHR-001 | chr()/ord() String Building Obfuscation | obfuscation/char_obfuscation | high 65 | python | T1027
  re chr\s*\(\s*\d+\s*\)\s*\+\s*chr\s*\(
OBF-LAYER-001 | Multi-Layer Obfuscation Chain | obfuscation/layered | critical 95 | python | T1027.002
  re exec.*marshal.*zlib.*b64decode
  re exec\s*\(.*decompress.*b64decode
OBF-ROT-001 | ROT13 Encoding | obfuscation/rot_encoding | medium 45 | python | T1027
  re codecs\.decode.*rot.13
  lit rot_13
OBF-UNICODE-001 | Unicode Escape Obfuscation | obfuscation/unicode | medium 55 | python,javascript | T1027
  re \\u[0-9a-fA-F]{4}.*\\u[0-9a-fA-F]{4}.*\\u[0-9a-fA-F]{4}
OBF-PYARMOR-001 | PyArmor Obfuscation Markers | obfuscation/commercial_obfuscation | medium 45 | python | T1027.002
  lit pytransform
  lit __pyarmor__

# permissions
PERM-CAM-001 | Camera Access (OpenCV) | collection/camera | high 75 | python | T1125
  re VideoCapture\s*\(\s*0\s*\)
  lit cv2\.VideoCapture
PERM-CAM-002 | Camera Access (JavaScript) | collection/camera | high 75 | javascript | T1125
  re getUserMedia\s*\(.*video\s*:\s*true
PERM-MIC-001 | Microphone Access (pyaudio/sounddevice) | collection/microphone | high 75 | python | T1123
  re import\s+pyaudio
  re import\s+sounddevice
  re PyAudio\s*\(
  re sounddevice\.rec\s*\(
PERM-MIC-002 | Microphone Access (JavaScript) | collection/microphone | high 75 | javascript | T1123
  re getUserMedia\s*\(.*audio\s*:\s*true
PERM-SCR-001 | Screen Capture (Python mss/PIL) | collection/screen_capture | high 70 | python | T1113
  re import\s+mss
  lit ImageGrab\.grab
  lit pyautogui\.screenshot
  lit PIL\.ImageGrab
PERM-KEY-001 | Keylogger - pynput | collection/keylogging | critical 90 | python | T1056.001
  re pynput\.keyboard.*Listener
  re from\s+pynput\.keyboard\s+import\s+Listener
PERM-KEY-002 | Keylogger - Win32 Hook | collection/keylogging | critical 95 | python,powershell | T1056.001
  lit SetWindowsHookEx
  lit WH_KEYBOARD_LL
  lit GetAsyncKeyState
PERM-CLIP-001 | Clipboard Access | collection/clipboard | medium 55 | python,javascript,powershell | T1115
  lit pyperclip\.paste
  lit win32clipboard
  lit GetClipboardData
  re xclip\s+-o
  lit pbpaste
PERM-LOC-001 | Location/GPS Access | collection/location | medium 50 | javascript | T1430
  lit geolocation\.getCurrentPosition
  lit navigator\.geolocation
PERM-BGSERV-001 | Background Service/Daemon Creation | persistence/background_service | high 65 | python,shell | T1543
  re import\s+daemon
  lit python-daemon
  lit Daemonize
  re os\.fork\s*\(\s*\)
PERM-BROWSER-001 | Browser Data Access | credential_access/browser_data | critical 85 | python,shell | T1555.003
  lit Login Data
  re Chrome.*Cookies
  re firefox.*places\.sqlite
  lit keychain
PERM-ADMIN-001 | Administrator/Root Privilege Request | privilege_escalation/admin_request | high 65 | python,shell,powershell | T1548
  re os\.getuid\s*\(\s*\)\s*==\s*0
  re RunAs.*administrator
  re ShellExecuteW.*runas
  lit IsUserAnAdmin

# persistence
PERS-CRON-001 | Crontab Modification | persistence/cron | high 75 | shell,python | T1053.003
  lit crontab
  re /etc/cron\.d/
  lit /var/spool/cron
PERS-REG-001 | Windows Run Key Persistence | persistence/registry | critical 85 | python,powershell | T1547.001
  lit CurrentVersion\\Run
  re HKCU.*Software.*Microsoft.*Windows.*CurrentVersion.*Run
  re HKLM.*Software.*Microsoft.*Windows.*CurrentVersion.*Run
PERS-START-001 | Windows Startup Folder | persistence/startup_folder | critical 80 | python,powershell,shell | T1547.001
  re Start Menu.*Programs.*Startup
  lit shell:startup
  re AppData.*Roaming.*Microsoft.*Windows.*Start Menu.*Programs.*Startup
PERS-SYSD-001 | Systemd Service Creation | persistence/systemd | critical 80 | shell,python | T1543.002
  re /etc/systemd/system/.*\.service
  re systemctl\s+(enable|start)
PERS-LAUNCH-001 | macOS LaunchAgent Persistence | persistence/launch_agent | critical 80 | shell,python | T1543.001
  lit Library/LaunchAgents
  lit Library/LaunchDaemons
  re launchctl\s+load
PERS-SSH-001 | SSH authorized_keys Injection | persistence/ssh_backdoor | critical 85 | shell,python | T1098.004
  lit authorized_keys
PERS-WMI-001 | WMI Event Subscription | persistence/wmi | critical 85 | powershell | T1546.003
  lit __EventFilter
  lit CommandLineEventConsumer
  lit Set-WmiInstance
PERS-DLL-001 | DLL Hijacking Setup | persistence/dll_hijacking | critical 85 | python,powershell | T1574.001
  re \.dll.*System32
  lit DllMain
  re copy.*\.dll

# powershell
PS-ENC-001 | PowerShell Encoded Command | obfuscation/encoded_command | critical 85 | powershell | T1027
  lit -EncodedCommand
  re -enc\b
  re -e\s+[A-Za-z0-9+/=]{20,}
PS-ENC-002 | ExecutionPolicy Bypass | defense_evasion/policy_bypass | high 70 | powershell | T1059.001
  re -ExecutionPolicy\s+Bypass
  re -ExecutionPolicy\s+Unrestricted
  re Set-ExecutionPolicy\s+Bypass
PS-ENC-003 | Hidden Window Execution | defense_evasion/hidden_execution | high 75 | powershell | T1564
  re -WindowStyle\s+Hidden
  re -W\s+Hidden
PS-IEX-001 | Invoke-Expression (Dynamic Execution) | execution/dynamic_code | critical 85 | powershell | T1059.001
  lit Invoke-Expression
  re \bIEX\b
PS-IEX-002 | Obfuscated IEX (Backtick) | obfuscation/obfuscated_iex | critical 90 | powershell | T1027
  lit I`E`X
  lit `i`e`x
PS-DL-001 | WebClient DownloadString | execution/remote_execution | critical 85 | powershell | T1105
  re Net\.WebClient.*DownloadString
  re WebClient\(\)\.DownloadString
PS-DL-002 | WebClient DownloadFile | execution/file_download | high 75 | powershell | T1105
  re DownloadFile\s*\(
  re Invoke-WebRequest.*OutFile
PS-DL-003 | Download and Execute (IEX + WebClient) | execution/remote_execution | critical 95 | powershell | T1059.001
  re IEX.*DownloadString
  re Invoke-Expression.*WebClient
  re IEX\s*\(\s*\(New-Object
PS-AMSI-001 | AMSI Bypass Attempt | defense_evasion/amsi_bypass | critical 95 | powershell | T1562.001
  lit AmsiUtils
  lit amsiInitFailed
  lit AmsiScanBuffer
PS-AMSI-002 | Disable Windows Defender | defense_evasion/av_disable | critical 95 | powershell | T1562.001
  re Set-MpPreference\s+-DisableRealtimeMonitoring\s+\$true
  re Set-MpPreference.*Disable.*true
PS-AMSI-003 | Defender Exclusion Addition | defense_evasion/av_exclusion | critical 85 | powershell | T1562.001
  re Add-MpPreference\s+-ExclusionPath
PS-REG-001 | Registry Run Key Persistence | persistence/registry_run | critical 90 | powershell | T1547.001
  lit CurrentVersion\\Run
  re HKCU.*Run
  re HKLM.*Run
PS-TASK-001 | Scheduled Task Creation | persistence/scheduled_task | critical 80 | powershell | T1053.005
  lit New-ScheduledTask
  lit Register-ScheduledTask
  re schtasks\s+/create
PS-CRED-001 | Mimikatz Credential Dumping | credential_access/credential_dumping | critical 95 | powershell | T1003.001
  lit Invoke-Mimikatz
  lit mimikatz
  lit sekurlsa::logonpasswords
PS-WMI-001 | WMI Event Subscription Persistence | persistence/wmi | critical 85 | powershell | T1546.003
  lit Set-WmiInstance
  lit __EventFilter
  lit CommandLineEventConsumer
PS-SHADOW-001 | Shadow Copy Deletion (Ransomware) | impact/shadow_copies | critical 90 | powershell | T1490
  re vssadmin\s+delete\s+shadows
  re Delete-WmiObject.*Win32_ShadowCopy

# python
PY-EXEC-001 | Dynamic eval() Execution | execution/dynamic_code | critical 85 | python | T1059.006
  re eval\s*\(
PY-EXEC-002 | Dynamic exec() Execution | execution/dynamic_code | critical 85 | python | T1059.006
  re exec\s*\(
PY-EXEC-003 | Dynamic compile() Usage | execution/dynamic_code | high 60 | python | T1059.006
  re compile\s*\(
PY-EXEC-004 | Dynamic __import__ Call | execution/dynamic_import | high 70 | python | T1059.006
  re __import__\s*\(
PY-EXEC-005 | os.system() Shell Command | execution/shell_command | high 75 | python | T1059
  re os\.system\s*\(
PY-EXEC-006 | os.popen() Shell Command | execution/shell_command | high 75 | python | T1059
  re os\.popen\s*\(
PY-EXEC-007 | subprocess.Popen with shell=True | execution/shell_command | high 70 | python | T1059
  re Popen\s*\([^)]*shell\s*=\s*True
PY-EXEC-008 | subprocess.call with shell=True | execution/shell_command | high 70 | python | T1059
  re subprocess\.call\s*\([^)]*shell\s*=\s*True
PY-IMP-001 | ctypes Import (Memory Access) | execution/low_level_access | medium 50 | python | T1055
  re import\s+ctypes
  re from\s+ctypes
PY-IMP-002 | winreg Import (Registry Access) | persistence/registry | high 65 | python | T1547.001
  re import\s+winreg
  re import\s+_winreg
PY-IMP-003 | pickle Import (Deserialization Risk) | execution/deserialization | medium 55 | python | T1059.006
  re import\s+pickle
PY-IMP-004 | marshal Import (Code Object Obfuscation) | obfuscation/code_object | high 60 | python | T1027.002
  re import\s+marshal
PY-FILE-001 | Reading /etc/shadow (Password Hashes) | credential_access/password_file | critical 90 | python | T1003.008
  lit /etc/shadow
PY-FILE-002 | Reading /etc/passwd (User Enumeration) | discovery/user_enum | medium 40 | python | T1087
  lit /etc/passwd
PY-FILE-003 | Reading SSH Private Keys | credential_access/ssh_keys | critical 85 | python | T1552.004
  lit \.ssh/id_rsa
  lit \.ssh/id_ed25519
  lit \.ssh/id_ecdsa
  lit \.ssh/id_dsa
PY-FILE-004 | Browser Cookie/Password Database Access | credential_access/browser_data | critical 85 | python | T1555.003
  lit Google/Chrome/User Data
  lit Chrome/User Data/Default/Login Data
  lit Mozilla/Firefox/Profiles
  re AppData.*Chrome.*Cookies
  lit Local Storage/leveldb
PY-FILE-005 | Reading .env File (Secret Exposure) | credential_access/env_secrets | medium 60 | python | T1552.001
  re open\s*\(['"]?\.env['"]?
  lit load_dotenv
PY-FILE-006 | Reading AWS Credentials | credential_access/cloud_credentials | critical 90 | python | T1552.001
  lit \.aws/credentials
  lit AWS_ACCESS_KEY_ID
  lit AWS_SECRET_ACCESS_KEY
PY-FILE-007 | Discord Token Theft | credential_access/token_theft | critical 85 | python | T1528
  re discord.*Local Storage
  re discordapp.*leveldb
  lit discord/Local Storage
PY-DESER-001 | pickle.loads() Deserialization | execution/deserialization | high 70 | python | T1059.006
  re pickle\.loads\s*\(
  re pickle\.load\s*\(
PY-DUP-001 | os.dup2() Stream Redirection (Reverse Shell) | network/reverse_shell | critical 95 | python | T1059.006
  re os\.dup2\s*\(
PY-SOCK-001 | Outbound Socket Connection | network/outbound_connection | medium 50 | python | T1071
  re socket\.connect\s*\(
PY-SOCK-002 | Bind Shell (Listening Socket) | network/bind_shell | critical 85 | python | T1059.006
  re socket\.bind\s*\(.*socket\.listen
  re \.bind\s*\(.*\.listen\s*\(
PY-WEBHOOK-001 | Discord Webhook Data Exfiltration | exfiltration/webhook | critical 90 | python | T1567
  lit discord\.com/api/webhooks
  lit discordapp\.com/api/webhooks
PY-WEBHOOK-002 | Telegram Bot Data Exfiltration | exfiltration/webhook | critical 90 | python | T1102
  lit api\.telegram\.org/bot
  re telegram\.Bot\s*\(
PY-KEY-001 | Keylogger - pynput Keyboard Listener | collection/keylogging | critical 95 | python | T1056.001
  re from\s+pynput
  re import\s+pynput
  lit pynput\.keyboard
PY-KEY-002 | Keylogger - keyboard Module | collection/keylogging | critical 90 | python | T1056.001
  re import\s+keyboard
  lit keyboard\.on_press
  lit keyboard\.hook

# shell
SH-REV-001 | Bash Reverse Shell via /dev/tcp | network/reverse_shell | critical 95 | shell | T1059.004
  lit /dev/tcp/
  re bash\s+-i\s+>&
  lit 0>&1
SH-REV-002 | Netcat Reverse Shell | network/reverse_shell | critical 95 | shell | T1059.004
  re nc\s+-e\s+/bin/(ba)?sh
  re nc\s+-c\s+bash
  re ncat\s+.*--exec
SH-REV-003 | Netcat mkfifo Reverse Shell | network/reverse_shell | critical 95 | shell | T1059.004
  re mkfifo.*nc
  re mkfifo\s+/tmp
SH-REV-004 | socat Reverse Shell | network/reverse_shell | critical 95 | shell | T1059.004
  re socat.*exec.*bash
  re socat.*TCP.*EXEC
SH-PRIV-001 | World-Writable Permissions (chmod 777) | privilege_escalation/file_permissions | high 60 | shell | T1222.002
  re chmod\s+777
  re chmod\s+-R\s+777
SH-PRIV-002 | SUID Bit Setting (chmod +s) | privilege_escalation/suid | critical 85 | shell | T1548.001
  re chmod\s+\+s
  re chmod\s+u\+s
  re chmod\s+4[0-9]{3}
SH-PRIV-003 | chown to root | privilege_escalation/ownership | high 70 | shell | T1222.002
  re chown\s+root
  re chown\s+0:0
SH-PRIV-004 | Sudoers File Modification | privilege_escalation/sudo | critical 90 | shell | T1548.003
  lit /etc/sudoers
  re echo.*NOPASSWD.*>>.*/etc/sudoers
SH-DEST-001 | Filesystem Wipe (rm -rf /) | impact/data_destruction | critical 95 | shell | T1485
  re rm\s+-rf\s+/
  re rm\s+-rf\s+\$HOME
  re rm\s+--no-preserve-root
SH-DEST-002 | Disk Overwrite via dd | impact/disk_wipe | critical 95 | shell | T1561.001
  re dd\s+if=/dev/(zero|urandom|null)\s+of=/dev/sd
  re dd\s+if=/dev/zero\s+of=
SH-DEST-003 | Disk Format (mkfs) | impact/disk_wipe | critical 90 | shell | T1561.002
  re mkfs\.(ext[234]|xfs|btrfs|fat)\s+/dev/
SH-DEST-004 | Fork Bomb | impact/denial_of_service | critical 85 | shell | T1499
  re :\(\)\s*\{\s*:|
  lit :(){:|:&};:
SH-PERS-001 | Crontab Persistence | persistence/cron | high 75 | shell | T1053.003
  re crontab\s+-e
  re crontab\s+-l.*>>
  re echo.*>>\s*/var/spool/cron
  re echo.*>>.*crontab
SH-PERS-002 | Shell Profile Modification | persistence/shell_profile | high 70 | shell | T1546.004
  re >>\s*~?/?\.bashrc
  re >>\s*~?/?\.bash_profile
  re >>\s*~?/?\.zshrc
  re >>\s*/etc/profile
SH-PERS-003 | rc.local Boot Persistence | persistence/boot_script | critical 80 | shell | T1037.004
  re >>\s*/etc/rc\.local
  lit /etc/rc\.d/
SH-PERS-004 | Systemd Service Installation | persistence/systemd | critical 80 | shell | T1543.002
  re systemctl\s+enable
  re /etc/systemd/system/.*\.service
SH-PERS-005 | SSH authorized_keys Injection | persistence/ssh_backdoor | critical 85 | shell | T1098.004
  re >>.*authorized_keys
  lit \.ssh/authorized_keys
SH-EXFIL-001 | curl Data Exfiltration (POST) | exfiltration/http_exfil | critical 80 | shell | T1048.003
  re curl\s+.*-X\s+POST.*-d\s+@
  re curl\s+.*--data-binary\s+@
  re curl\s+.*-F.*@
SH-EXEC-001 | curl Pipe to Bash (Remote Execution) | execution/remote_execution | critical 90 | shell | T1105
  re curl.*\|\s*(ba)?sh
  re curl.*\|\s*bash
SH-EXEC-002 | wget Pipe to Bash (Remote Execution) | execution/remote_execution | critical 90 | shell | T1105
  re wget.*\|\s*(ba)?sh
  re wget.*-O-.*\|
SH-SHADOW-001 | Reading /etc/shadow | credential_access/password_file | critical 90 | shell | T1003.008
  re cat\s+/etc/shadow
  lit /etc/shadow
"""
